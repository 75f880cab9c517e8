"""Plain versions of the operators, and documents with every odd case."""

from __future__ import annotations

import hashlib
import random
import re

AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = ("doc_id bigint, text string, lang string, source string, n_chars bigint, score double, row string, token string, "
          "n_words string, lang_pred string, n_removed string, id bigint, part int")
LAST = (1 << 63) - 1


def blank_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def alnum_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(AZ))


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def prose(seed, n, words=400):
    pick = random.Random(seed)
    return " ".join(f"w{pick.randrange(words)}" + (".\n" if pick.random() < 0.08 else "") for _ in range(n))


def odd_rows():
    """``(doc_id, text, lang)``: nulls, empty and very long texts, repeated rows, copies, shared passages."""
    base, passage = prose(1, 300), prose(2, 40, 10**6).replace("\n", " ")
    edited = base.split(" ")
    edited[150] = "changed"
    lines = "A line that several documents have in common, word by word.\n"
    return [
        (1, prose(3, 20000, 5000), "aa"), (2, None, "aa"), (3, "", None), (4, " \t\n \r\n", "aa"), (5, base, "aa"), (6, base, "bb"),
        (7, " ".join(edited), "aa"), (8, passage, "aa"), (9, prose(4, 60) + " " + passage + " " + prose(5, 60), "aa"),
        (10, lines + prose(6, 50), "bb"), (11, lines + prose(7, 50), "bb"), (12, lines.replace("several", "severel") + prose(8, 50), "bb"),
        (12, lines.replace("several", "severel") + prose(8, 50), "bb"), (13, "Ünï\U0001F600cödé ẞtraße 漢字 " * 10, "aa"),
        (14, "12 34 ... !!", None), (15, "one two", "aa"), (16, "one two", "aa"), (17, "ONE TWO", "bb"), (18, "same " * 40, "bb"),
        (None, passage + " tail", "aa"), (None, None, None), (19, "Released under the MIT license.\nAll rights reserved.", "aa"),
        (20, "gnu General PUBLIC license, mit license; CC BY\nApache  License", None), (21, "a\x00b <|endoftext|> \x1c c", "aa"),
        (22, prose(9, 30) + "\n### $$$ %%% &&&\n" * 5, "bb"),
    ]


def odd_documents(spark, rows=None):
    rows = odd_rows() if rows is None else rows
    return spark.createDataFrame([(i, t, lang, "s", None if t is None else len(t), 0.5, "r", "t", "w", "p", "n", 7, 1) for i, t, lang in rows],
                                 SCHEMA).repartition(3)


def as_rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def substring_dedup(rows, width=13):
    first = {}
    for i, t, *_ in rows:
        w = blank_words(t)
        for k in range(len(w) - width + 1):
            key = tuple(w[k:k + width])
            first[key] = min(first.get(key, LAST), LAST if i is None else i)
    out = []
    for i, t, *_ in rows:
        w, own = blank_words(t), LAST if i is None else i
        gone = set()
        for k in range(len(w) - width + 1):
            if first[tuple(w[k:k + width])] < own:
                gone.update(range(k, k + width))
        out.append((i, len(w), len(gone), sha(" ".join(x for k, x in enumerate(w) if k not in gone))))
    return sorted(out, key=repr)


def decontamination(rows, items, window=10):
    windows = {}
    for name, t in items:
        w = alnum_words(t)
        n = min(window, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[k:k + n]), set()).add(str(name))
    out = []
    for i, t, *_ in rows:
        w, hit, found = alnum_words(t), set(), set()
        for n in {len(k) for k in windows}:
            for k in range(len(w) - n + 1):
                names = windows.get(tuple(w[k:k + n]))
                if names:
                    found |= names
                    hit.update(range(k, k + n))
        out.append((i, len(w), len(hit), len(found), sha(",".join(sorted(found))), bool(hit)))
    return sorted(out, key=repr)


def components(keys, linked):
    parent = {k: k for k in keys}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in linked:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {k: root(k) for k in keys}


def jaccard(rows, percent=85, width=4):
    sets = []
    for i, t, *_ in rows:
        w = blank_words((t or "").translate(AZ))
        s = {tuple(w[k:k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())
        sets.append((LAST if i is None else i, s))
    linked = [(a, b) for n, (a, x) in enumerate(sets) for b, y in sets[:n] if x and y and 100 * len(x & y) >= percent * len(x | y)]
    root = components({i for i, _ in sets}, linked)
    none = lambda x: None if x == LAST else x
    return sorted(((none(i), len(s), none(root[i] if s else i)) for i, s in sets), key=repr)


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            now.append(min(row[j] + 1, now[-1] + 1, row[j - 1] + (x != y)))
        row = now
    return row[-1]


def line_dedup(rows, edits=2, min_chars=24):
    """Rows with ``doc_id, n_lines, n_removed, n_near, hash of what is left``."""
    place = lambda i, k: (-LAST if i is None else i, k)
    first = {}
    for i, t, *_ in rows:
        for k, line in enumerate((t or "").split("\n")):
            if re.search(r"[^\x20\x09-\x0D]", line):
                first[line] = min(first.get(line, (LAST, 0)), place(i, k))
    long = [x for x in first if len(x) >= min_chars]
    near = {a for a in long for b in long if a != b and first[b] < first[a] and abs(len(a) - len(b)) <= edits and edit_distance(a, b) <= edits}
    out = []
    for i, t, *_ in rows:
        lines, keep, removed, n_near = (t or "").split("\n"), [], 0, 0
        for k, line in enumerate(lines):
            if line in first and (line in near or first[line] != place(i, k)):
                removed += 1
                n_near += line in near
            else:
                keep.append(line)
        out.append((i, 0 if t is None else len(lines), removed, n_near, sha("\n".join(keep))))
    return sorted(out, key=repr)


def license_base(rows):
    phrases = {"gpl": ["gnu", "general", "public", "license"], "apache": ["apache", "license"], "cc-by": ["cc", "by"], "mit": ["mit", "license"]}
    out = []
    for i, t, *_ in rows:
        w = alnum_words(t)
        hits = [(k, label) for k in range(len(w)) for label, p in phrases.items() if w[k:k + len(p)] == p]
        at = [k for k, _ in hits]
        out.append((i, len(w), len(hits), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in hits}))))
    return sorted(out, key=repr)


def quality_counts(rows):
    out = []
    for i, t, *_ in rows:
        w, seen, dup, at, cover = blank_words(t), set(), 0, {}, set()
        for line in (t or "").split("\n"):
            if blank_words(line):
                dup += line in seen
                seen.add(line)
        for k in range(len(w) - 7):
            at.setdefault(tuple(w[k:k + 8]), []).append(k)
        for places in at.values():
            if len(places) > 1:
                for k in places:
                    cover.update(range(k, k + 8))
        out.append((i, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), dup, len(cover),
                    len(w) < 20 or 100 * len(cover) > 30 * len(w)))
    return sorted(out, key=repr)
