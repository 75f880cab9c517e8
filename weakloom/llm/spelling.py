"""Grouping spelling variants: words one edit apart, found through an index of variable-length grams.

1. Words are counted per task and summed.
2. A gram dictionary is built from the words: a gram is extended by one character where it stands in more than
   ``EXTEND`` of all gram places, and the extension is kept where it stands in more than ``KEEP`` of them. Both are
   shares, so the dictionary has at most ``1 / KEEP`` grams per length whatever the data.
3. Every word is cut into grams of variable length: at each place the longest gram of the dictionary, or the shortest
   length if there is none; grams inside an earlier one are left out.
4. For each word, the most grams one edit can change (``affected``) bounds from below what a near word shares with it.
5. Lists of the word's rarest grams, one more than can change, are merged by gram, place and length. Words that meet there and
   lack no more of each other's grams than the bounds allow are verified by edit distance.
6. Words whose grams can all change meet each other over their halves, one of which an edit leaves alone.

Nothing is sampled or capped; the lists differ in length only, and a long list is a hot key of a join that Spark splits.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterable, Iterator, Mapping, Sequence
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weakloom.llm.store import stored

#: Shortest and longest gram.
SHORT, LONG = 2, 4
#: Share of the gram places of one length from which a gram is extended, and from which the extension is kept.
EXTEND, KEEP = 1 / 4000, 1 / 40000
#: Words held in one task's table before it is passed on.
TABLE_WORDS = 400_000

#: Bytes of a Latin-1 text: letters in lower case (A-Z only), everything else blank. Other characters are blanked before.
_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 0xC0 else 32 for c in range(256))
#: Marks before and after a word; they are no letters.
_HEAD, _TAIL = "\x02", "\x03"


# --- words --------------------------------------------------------------------------------

def runs_of(text: str) -> list[bytes]:
    """Maximal runs of letters as Latin-1 bytes, A-Z lower-cased."""
    return text.encode("latin-1", "replace").translate(_LETTERS).split()


def _utf8(word: bytes) -> bytes:
    return word if word.isascii() else word.decode("latin-1").encode()


def words_of(doc_id: int | None, text: str, shortest: int, slip: int) -> Counter:
    """Counts of the words of one text. In about one of ``slip`` pairs of document and word, a character is dropped."""
    counts = Counter(w for w in runs_of(text) if len(w) >= shortest)
    start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    out: Counter = Counter()
    for word, n in counts.items():
        h = zlib.crc32(_utf8(word), start)
        if slip and h % slip == 0:
            at = h % len(word)
            word = word[:at] + word[at + 1:]
            if len(word) < shortest:
                continue
        out[word] += n
    return out


def count_words(docs: DataFrame, shortest: int = 6, least: int = 5, slip: int = 199) -> DataFrame:
    """``word, n`` of all words of at least ``shortest`` characters with at least ``least`` occurrences.

    A null text has no words; a null ``doc_id`` counts as an empty one in the checksum. ``slip`` 0 drops nothing.
    """
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1)):
                value = text.as_py()
                if value:
                    total.update(words_of(doc_id.as_py(), value, shortest, slip))
                if len(total) >= TABLE_WORDS:
                    yield _counted(total)
                    total.clear()
        yield _counted(total)

    found = docs.select("doc_id", "text").mapInArrow(count, "word string, n bigint")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def _counted(total: Mapping[bytes, int]) -> pa.RecordBatch:
    return pa.record_batch({"word": pa.array([w.decode("latin-1") for w in total], pa.string()),
                            "n": pa.array(total.values(), pa.int64())})


# --- grams --------------------------------------------------------------------------------

class GramDictionary(NamedTuple):
    """Grams longer than ``short``, their proper beginnings and their proper ends."""

    short: int
    long: int
    grams: frozenset
    heads: frozenset
    tails: frozenset


def dictionary_of(counts: Iterable[tuple[str, int]], short: int = SHORT, long: int = LONG,
                  extend: float = EXTEND, keep: float = KEEP) -> GramDictionary:
    """The dictionary from counts of grams of all lengths."""
    counts = dict(counts)
    places = Counter()
    for gram, n in counts.items():
        places[len(gram)] += n
    grams = frozenset(g for g, n in counts.items() if short < len(g) <= long and n > keep * places[len(g)]
                      and counts.get(g[:-1], 0) > extend * places[len(g) - 1])
    return GramDictionary(short, long, grams, frozenset(g[:i] for g in grams for i in range(1, len(g))),
                          frozenset(g[i:] for g in grams for i in range(1, len(g))))


def padded(word: str, long: int) -> str:
    return _HEAD * (long - 1) + word + _TAIL * (long - 1)


def decompose(text: str, book: GramDictionary) -> list[tuple[int, int]]:
    """Places ``(first, end)`` of the grams of a padded word; both rise from gram to gram."""
    out, reach, last = [], 0, len(text)
    for at in range(last - book.short + 1):
        end = at + book.short
        for size in range(min(book.long, last - at), book.short, -1):
            if text[at:at + size] in book.grams:
                end = at + size
                break
        if end > reach:
            out.append((at, end))
            reach = end
    return out


def affected(text: str, places: Sequence[tuple[int, int]], book: GramDictionary) -> int:
    """The most distinct grams that one edit of the word inside the padded ``text`` can change or move out of line.

    What stands before an edit keeps its grams unless a gram of the dictionary could now begin at or before them and reach over the
    edit: then some part of the text up to the edit is the beginning of a gram. What stands behind keeps its grams unless a
    gram that begins before could now cover them: then some part of the text from the edit on is the end of a gram.
    """
    pad, last = book.long - 1, len(text)
    firsts, ends = [p[0] for p in places], [p[1] for p in places]
    names = [text[a:b] for a, b in places]
    repeated = len(set(names)) < len(names)
    left, right = {}, {}
    for edge in range(pad, last - pad + 1):
        begin = next((a for a in range(max(0, edge - book.long + 1), edge) if text[a:edge] in book.heads), edge)
        left[edge] = min(bisect_right(ends, edge), bisect_left(firsts, begin))
        close = next((e for e in range(min(last, edge + book.long - 1), edge, -1) if text[edge:e] in book.tails), edge)
        right[edge] = max(bisect_left(firsts, edge), bisect_right(ends, close))
    worst, distinct = 0, len(set(names))
    for edge in range(pad, last - pad + 1):
        for after in (edge, edge + 1):
            if after in right:
                if repeated:
                    lost = distinct - len({*names[:left[edge]], *names[right[after]:]})
                else:
                    lost = distinct - left[edge] - max(0, distinct - right[after])
                worst = max(worst, lost)
    return worst


def gram_counts(words: DataFrame, short: int = SHORT, long: int = LONG) -> DataFrame:
    """``gram, n``: places of the grams of each length in the padded words."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total: Counter = Counter()
            for word in batch.column(0).to_pylist():
                text = padded(word, long)
                for size in range(short, long + 1):
                    total.update([text[i:i + size] for i in range(len(text) - size + 1)])
            yield pa.record_batch({"gram": pa.array(total.keys(), pa.string()), "n": pa.array(total.values(), pa.int64())})

    return words.select("word").mapInArrow(count, "gram string, n bigint").groupBy("gram").agg(F.sum("n").alias("n"))


def fit_dictionary(words: DataFrame, short: int = SHORT, long: int = LONG, extend: float = EXTEND, keep: float = KEEP) -> GramDictionary:
    """The dictionary of a word table. Only grams that pass the shares reach the driver, at most ``1 / min(keep, extend)`` per length."""
    counts = stored(gram_counts(words, short, long).withColumn("size", F.char_length("gram")), "gram-counts")
    places = counts.groupBy("size").agg(F.sum("n").alias("places"))
    heavy = counts.join(F.broadcast(places), "size").where(F.col("n") > F.col("places") * min(keep, extend))
    totals = {r["size"]: r["places"] for r in places.collect()}
    table = dict(zip(*[c.to_pylist() for c in heavy.select("gram", "n").toArrow().columns]))
    # Shares refer to all places, so the rest is counted under names that are no grams.
    for size, places_of_size in totals.items():
        table["\x00" * size] = places_of_size - sum(n for g, n in table.items() if len(g) == size)
    book = dictionary_of(table.items(), short, long, extend, keep)
    return book._replace(grams=frozenset(g for g in book.grams if "\x00" not in g))


# --- lists --------------------------------------------------------------------------------

_CUT = "word string, n bigint, size int, grams array<string>, places array<int>, least int"
_LISTED = "key bigint, longer boolean, word string, n bigint, bits bigint, lost int"


def cut_words(words: DataFrame, book: GramDictionary) -> DataFrame:
    """Each word with its grams, their places and the number of distinct grams that a near word shares with it at least."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column(0).to_pylist()
            grams, firsts, least = [], [], []
            for word in names:
                text = padded(word, book.long)
                places = decompose(text, book)
                own = [text[a:b] for a, b in places]
                grams.append(own)
                firsts.append([a for a, _ in places])
                least.append(len(set(own)) - affected(text, places, book))
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array([len(w) for w in names], pa.int32()),
                                   pa.array(grams, pa.list_(pa.string())), pa.array(firsts, pa.list_(pa.int32())),
                                   pa.array(least, pa.int32())], ["word", "n", "size", "grams", "places", "least"])

    return words.select("word", "n").mapInArrow(cut, _CUT)


def gram_ranks(cut: DataFrame) -> dict[str, int]:
    """The rank of each gram, those in fewest words first: grams of the dictionary and of the shortest length, a bounded number."""
    counts = cut.select(F.explode(F.array_distinct("grams")).alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    table = counts.toArrow().to_pydict()
    return {gram: rank for rank, (_, gram) in enumerate(sorted(zip(table["n"], table["gram"])))}


def _key(*parts: object) -> int:
    text = "\x1f".join(map(str, parts)).encode()
    h = zlib.crc32(text) << 32 | zlib.crc32(text, 0x9E3779B9)
    return h - (1 << 64) if h >= 1 << 63 else h


def entries(word: str, ranks: Sequence[int], places: Sequence[int], least: int) -> set[tuple[int, bool]]:
    """Keys of the lists a word stands in: as the shorter or an equally long one (false), and as the longer one (true).

    The keys are gram, place and length of the shorter word. A gram that one edit leaves alone keeps its place, or moves by one with the
    length. Of the grams in order of rank, near words share one among the first ``all - least + 1`` of each.
    """
    size, own = len(word), sorted(set(ranks))
    rarest = set(own[:len(own) - max(least, 1) + 1])
    out = set()
    for rank, place in zip(ranks, places):
        if rank in rarest:
            out |= {(_key(rank, place, size), False), (_key(rank, place, size - 1), True), (_key(rank, place - 1, size - 1), True)}
    if least <= 0:
        half, short = size // 2, (size - 1) // 2
        out |= {(_key("a", word[:half], size), False), (_key("b", word[half:], size), False),
                (_key("a", word[:short], size - 1), True), (_key("b", word[short + 1:], size - 1), True)}
    return out


def gram_lists(cut: DataFrame, ranks: Mapping[str, int]) -> DataFrame:
    """The entries of all words. ``bits`` are their grams in a small bit set and ``lost`` the most grams an edit can change."""
    sent = cut.sparkSession.sparkContext.broadcast(dict(ranks))

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank_of = sent.value
        for batch in batches:
            for start in range(0, batch.num_rows, 2000):
                part = batch.slice(start, 2000)
                keys, longer, row, bits, lost = [], [], [], [], []
                for i, (word, grams, places, least) in enumerate(zip(*[part.column(c).to_pylist() for c in (0, 3, 4, 5)])):
                    own = [rank_of[g] for g in grams]
                    held = 0
                    for rank in own:
                        held |= 1 << (rank * 0x9E3779B1 >> 7 & 63)
                    bits.append(held - (1 << 64) if held >= 1 << 63 else held)
                    lost.append(len(set(own)) - least)
                    for key, side in entries(word, own, places, least):
                        keys.append(key)
                        longer.append(side)
                        row.append(i)
                take = pa.array(row, pa.int64())
                yield pa.record_batch([pa.array(keys, pa.int64()), pa.array(longer, pa.bool_()), part.column(0).take(take),
                                       part.column(1).take(take), pa.array(bits, pa.int64()).take(take),
                                       pa.array(lost, pa.int32()).take(take)], ["key", "longer", "word", "n", "bits", "lost"])

    return cut.mapInArrow(listed, _LISTED)


def near_pairs(words: DataFrame, short: int = SHORT, long: int = LONG, extend: float = EXTEND, keep: float = KEEP) -> DataFrame:
    """``a, n_a, b, n_b``: all pairs of words (``word, n``, each once) that differ by one inserted, deleted or replaced character."""
    book = fit_dictionary(words, short, long, extend, keep)
    cut = stored(cut_words(words, book), "cut-words")
    lists = stored(gram_lists(cut, gram_ranks(cut)), "gram-lists")
    meet = (F.col("x.key") == F.col("y.key")) & (F.col("y.longer") | (F.col("x.word") < F.col("y.word")))
    # Of the grams of a word, a near one lacks no more than one edit can change.
    shared = (F.expr("bit_count(x.bits & ~y.bits)") <= F.col("x.lost")) & (F.expr("bit_count(y.bits & ~x.bits)") <= F.col("y.lost"))
    near = F.levenshtein("x.word", "y.word", 1) == 1
    found = lists.where("not longer").alias("x").join(lists.alias("y"), meet & shared & near)
    return found.select(F.col("x.word").alias("a"), F.col("x.n").alias("n_a"), F.col("y.word").alias("b"), F.col("y.n").alias("n_b")).distinct()


# --- groups -------------------------------------------------------------------------------

def _follow(forms: DataFrame) -> DataFrame:
    """``word, root``: the last form each word leads to. Forms are more frequent than their words, so chains end; each round doubles
    the step. A form that many words share is dealt over salted copies."""
    steps = stored(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        on = steps.select(F.col("word").alias("root"), F.col("root").alias("further"))
        further = stored(steps.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"),
                                                                F.col("further").isNotNull().alias("moved")), "roots")
        if not further.where("moved").limit(1).count():
            return further.select("word", "root")
        steps = further.drop("moved")


def variants(docs: DataFrame, shortest: int = 6, least: int = 5, slip: int = 199, times: int = 5) -> DataFrame:
    """One row per word of the texts: its near words and the more frequent form it is a variant of.

    ``n_near`` counts words one edit away. ``form`` is the near word with most occurrences (the first in code-point order on ties) if it
    has at least ``times`` as many as the word, and ``root`` the end of the chain of forms. Documents without text add nothing; no text at
    all gives no row.
    """
    words = stored(count_words(docs, shortest, least, slip), "words")
    pairs = stored(near_pairs(words), "near-words")
    ways = pairs.select("a", "b", "n_b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), F.col("n_a").alias("n_b")))
    best = F.min(F.struct((-F.col("n_b")).alias("less"), F.col("b").alias("form")))
    near = ways.groupBy(F.col("a").alias("word")).agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    fits = -F.col("best.less") >= F.col("n") * times

    def when_fit(value: Column) -> Column:
        return F.when(fits, value)

    judged = stored(words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), when_fit(F.col("best.form")).alias("form"),
        when_fit(-F.col("best.less")).alias("form_n")), "word-forms")
    roots = _follow(judged.where("form is not null"))
    return judged.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
