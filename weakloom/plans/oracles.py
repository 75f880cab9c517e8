"""The registered queries once more, as SQL for a second engine.

The statements are built from plain list and window functions and share no expression with
the Spark side; only phrase lists and rule parameters come from the same tables.
"""

from __future__ import annotations

import re

from weakloom.functions import lexicons
from weakloom.operators import labeling as lb
from weakloom.plans import standins as sd

TOKENS = r"regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+')"
BLANKS = r"[\t-\r\x1c-\x20\x{85}\p{Z}]+"
PUNCTUATION = r"[!-/:-@\[-`{-~]"
RULES = lb.default_rules()


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


# --- text ---------------------------------------------------------------------------------

CONV = "conv AS (SELECT conv_id AS doc_id, turn AS page, text FROM conversations)"
LINES = f"""{CONV},
split AS (SELECT doc_id, page, string_split(text, chr(10)) AS l FROM conv),
lines AS (SELECT doc_id, page, i - 1 AS pos, l[i] AS line
          FROM (SELECT doc_id, page, l, unnest(range(1, len(l) + 1)) AS i FROM split)),
numbered AS (SELECT *, row_number() OVER w - 1 AS line_no,
             coalesce(lag(line) OVER w, line) AS before
             FROM lines WINDOW w AS (PARTITION BY doc_id ORDER BY page, pos)),
flagged AS (SELECT *, lower(line) <> line AND length(line) <= 50
            AND (before = '' OR right(before, 1) = '.') AS is_title FROM numbered),
kept AS (SELECT doc_id, page, line, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) - 1 AS line_no
         FROM flagged WHERE NOT is_title),
placed AS (SELECT *, coalesce(sum(CASE WHEN right(line, 1) = '.' THEN 1 ELSE 0 END) OVER (
           PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS para_id
           FROM kept),
paragraphs AS (SELECT doc_id, para_id, min(page) AS first_page,
               trim(regexp_replace(string_agg(line, ' ' ORDER BY line_no), '{BLANKS}', ' ', 'g')) AS text
               FROM placed GROUP BY doc_id, para_id HAVING max(CASE WHEN right(line, 1) = '.' THEN 1 ELSE 0 END) = 1)"""
DOC_LINES = LINES.replace("SELECT conv_id AS doc_id, turn AS page, text FROM conversations",
                          "SELECT doc_id, 0 AS page, text FROM documents")


def cleaned(column: str) -> str:
    return (f"regexp_replace(lower(regexp_replace({column}, '[(\\[][^\\n]*?[)\\]]', '', 'g')), "
            f"'{PUNCTUATION}', '', 'g')")


TITLE_PATH = "'../data/raw/' || array_to_string(string_split(text, ' ')[1:5], ' ') || '.pdf'"


def path_words(column: str) -> str:
    return (f"list_transform(list_filter(string_split(replace({column}, '/', ' '), ' '), "
            "lambda w: w NOT IN ('..', 'data', 'raw')), lambda w: replace(w, '.pdf', ''))")


TITLES = f"""words AS (SELECT doc_id, text AS body, {path_words(TITLE_PATH)} AS w FROM documents),
grams AS (SELECT doc_id, body, flatten(list_transform(range(len(w), 2, -1), lambda n:
          list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i:i + n - 1], ' ')))) AS g FROM words)"""

# --- retrieval ------------------------------------------------------------------------------

SCORED = """scored AS (SELECT vec_id, label, list_cosine_similarity(embedding::DOUBLE[],
            (SELECT embedding FROM embeddings WHERE vec_id = 0)::DOUBLE[]) AS results FROM embeddings)"""
GOLD = """gold AS (SELECT d.doc_id, d.lang, d.text, CASE WHEN toxic = 1 THEN 2 WHEN quality = 1 THEN 3
          WHEN quality IS NOT NULL THEN 1 END AS class FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""
COUNTRIES = """countries AS (SELECT CASE lang WHEN 'de' THEN 'Germany' WHEN 'en' THEN 'England' WHEN 'es' THEN 'Spain'
               WHEN 'fr' THEN 'France' ELSE coalesce(lang, 'unknown') END AS country, doc_id, text FROM documents)"""

# --- hidden states ----------------------------------------------------------------------------

def _any_of(column: str, phrases) -> str:
    return "(" + " OR ".join(f"contains({column}, {q(p)})" for p in phrases) + ")"


def state_ctes(model) -> str:
    """CTEs up to ``fwd`` and ``bwd``, scaled, and ``obs`` with the likelihood of each paragraph's symbol per state."""
    low, states = f"lower({cleaned('text')})", range(model.n_states)
    symbol = (f"{_any_of(low, sd.PHRASES['specific_incentives'])}::INT + 2 * {_any_of(low, sd.PHRASES['negative_nouns'])}::INT "
              f"+ 4 * (length({cleaned('text')}) >= {sd.LONG_PARAGRAPH})::INT")
    seen = ", ".join(f"{[float(x) for x in row]}[o + 1] AS b{i}" for i, row in enumerate(model.emit))
    total = " + ".join(f"x{i}" for i in states)
    scaled = ", ".join(f"x{i} / ({total}) AS a{i}" for i in states)
    most = "greatest(" + ", ".join(f"x{i}" for i in states) + ")"
    begin = ", ".join(f"{p!r} * b{i} AS x{i}" for i, p in enumerate(model.start))
    forward = ", ".join("(" + " + ".join(f"f.a{i} * {model.step[i][j]!r}" for i in states) + f") * o.b{j} AS x{j}" for j in states)
    backward = ", ".join("(" + " + ".join(f"{model.step[i][j]!r} * o.b{j} * n.c{j}" for j in states) + f") AS x{i}" for i in states)
    return f"""{DOC_LINES},
sym AS (SELECT doc_id, para_id AS t, {symbol} AS o FROM paragraphs),
obs AS MATERIALIZED (SELECT doc_id, t, o, {seen} FROM sym),
ends AS MATERIALIZED (SELECT doc_id, max(t) AS last FROM obs GROUP BY doc_id),
fwd AS (SELECT doc_id, t, {scaled} FROM (SELECT doc_id, t, {begin} FROM obs WHERE t = 0)
        UNION ALL
        SELECT doc_id, t, {scaled} FROM (SELECT o.doc_id, o.t, {forward} FROM fwd f JOIN obs o ON o.doc_id = f.doc_id AND o.t = f.t + 1)),
bwd AS (SELECT doc_id, last AS t, {", ".join(f"1.0::DOUBLE AS c{i}" for i in states)} FROM ends
        UNION ALL
        SELECT doc_id, t, {", ".join(f"x{i} / {most} AS c{i}" for i in states)} FROM (
        SELECT o.doc_id, o.t - 1 AS t, {backward} FROM bwd n JOIN obs o ON o.doc_id = n.doc_id AND o.t = n.t WHERE n.t > 0)),
gamma AS MATERIALIZED (SELECT doc_id, t, o, {", ".join(f"a{i} * c{i} / (" + " + ".join(f"a{k} * c{k}" for k in states) + f") AS g{i}" for i in states)}
          FROM fwd JOIN bwd USING (doc_id, t) JOIN obs USING (doc_id, t))"""


def state_update_sql(model, smoothing: float) -> str:
    states, symbols = range(model.n_states), range(model.n_symbols)
    step = {(i, j): f"a{i} * {model.step[i][j]!r} * b{j} * c{j}" for i in states for j in states}
    total = " + ".join(step.values())
    pairs = " UNION ALL ".join(f"SELECT 'step' AS part, {i} AS i, {j} AS j, sum({x} / ({total})) AS n FROM moves" for (i, j), x in step.items())
    starts = " UNION ALL ".join(f"SELECT 'start', 0, {i}, sum(g{i}) FROM gamma WHERE t = 0" for i in states)
    emits = " UNION ALL ".join(f"SELECT 'emit', {i}, {k}, coalesce(sum(g{i}) FILTER (o = {k}), 0) FROM gamma" for i in states for k in symbols)
    return f"""WITH RECURSIVE {state_ctes(model)},
moves AS MATERIALIZED (SELECT {", ".join(f"f.a{i}, b{i}, c{i}" for i in states)} FROM fwd f JOIN obs o ON o.doc_id = f.doc_id AND o.t = f.t + 1
          JOIN bwd n ON n.doc_id = o.doc_id AND n.t = o.t),
counts AS (SELECT part, i, j, n + {smoothing} AS n FROM ({pairs} UNION ALL {starts} UNION ALL {emits}))
SELECT part, i, j, round(n / sum(n) OVER (PARTITION BY part, i), 6) AS p FROM counts"""

# --- topics -------------------------------------------------------------------------------------

TOPIC_TERMS = f"""words AS (SELECT doc_id, unnest({TOKENS}) AS term FROM documents),
entries AS MATERIALIZED (SELECT doc_id, term, count(*) AS n FROM words GROUP BY ALL),
chosen AS MATERIALIZED (SELECT term, row_number() OVER (ORDER BY count(*) DESC, term) - 1 AS place FROM entries GROUP BY term HAVING count(*) >= 2
           ORDER BY count(*) DESC, term LIMIT 300)"""


def topic_round_sql(n_topics: int, steps: int, smoothing: float) -> str:
    ks = range(n_topics)
    start = ", ".join(f"1 + ('0x' || left(md5(term || ' {k}'), 4))::INT / 65536.0 AS w{k}" for k in ks)
    scaled = ", ".join(f"w{k} / sum(w{k}) OVER () AS f{k}" for k in ks)
    ctes = [TOPIC_TERMS, f"weights AS (SELECT term, {start} FROM chosen)", f"shares AS MATERIALIZED (SELECT term, {scaled} FROM weights)",
            f"e0 AS MATERIALIZED (SELECT doc_id, term, n, {', '.join(f'f{k}' for k in ks)}, {', '.join(f'{1 / n_topics}::DOUBLE AS m{k}' for k in ks)} "
            "FROM entries JOIN shares USING (term))"]
    total = " + ".join(f"m{k} * f{k}" for k in ks)
    for step in range(1, steps + 1):
        mixed = ", ".join(f"sum(n * m{k} * f{k} / ({total})) / sum(n) AS m{k}" for k in ks)
        ctes.append(f"x{step} AS (SELECT doc_id, {mixed} FROM e{step - 1} GROUP BY doc_id)")
        ctes.append(f"e{step} AS MATERIALIZED (SELECT doc_id, term, n, {', '.join(f'f{k}' for k in ks)}, {', '.join(f'x{step}.m{k}' for k in ks)} "
                    f"FROM e{step - 1} JOIN x{step} USING (doc_id))")
    sums = " UNION ALL ".join(f"SELECT {k} AS topic, term, sum(n * m{k} * f{k} / ({total})) + {smoothing} AS s FROM e{steps} GROUP BY term" for k in ks)
    ctes.append(f"sums AS ({sums})")
    return "WITH " + ",\n".join(ctes) + "\nSELECT topic, term, round(s / sum(s) OVER (PARTITION BY topic), 6) AS share FROM sums"
# --- words used alike ---------------------------------------------------------------------------

WORD_INFORMATION = f"""{TOPIC_TERMS},
placed AS (SELECT doc_id, t, unnest(range(1, len(t) + 1)) AS i FROM (SELECT doc_id, {TOKENS} AS t FROM documents)),
known AS MATERIALIZED (SELECT doc_id, i, t[i] AS term FROM placed WHERE t[i] IN (SELECT term FROM chosen)),
near AS (SELECT x.term AS a, y.term AS b FROM known x JOIN known y ON x.doc_id = y.doc_id AND y.i IN (x.i + 1, x.i + 2) WHERE x.term <> y.term),
meetings AS MATERIALIZED (SELECT a, b, count(*) AS n FROM (SELECT a, b FROM near UNION ALL SELECT b, a FROM near) GROUP BY ALL),
alone AS (SELECT a AS word, sum(n) AS n FROM meetings GROUP BY a),
vectors AS MATERIALIZED (SELECT a, b, ln(m.n::DOUBLE * (SELECT sum(n) FROM meetings) / (x.n::DOUBLE * y.n)) AS weight
           FROM meetings m JOIN alone x ON x.word = a JOIN alone y ON y.word = b WHERE weight > 0)"""


def word_neighbours_sql(tables: int, planes: int, most: int, similar: float) -> str:
    return f"""WITH {WORD_INFORMATION},
sums AS (SELECT a, p AS plane, sum(weight * CASE WHEN ('0x' || left(md5(b || ' ' || p), 1))::INT < 8 THEN 1.0 ELSE -1.0 END) AS s
         FROM vectors, range({tables * planes}) r(p) GROUP BY ALL),
buckets AS MATERIALIZED (SELECT a AS word, plane // {planes} AS t, sum(CASE WHEN s > 0 THEN 1 << (plane % {planes})::INT ELSE 0 END) AS bucket FROM sums GROUP BY ALL),
pairs AS (SELECT DISTINCT x.word, y.word AS neighbour FROM buckets x JOIN buckets y USING (t, bucket) WHERE x.word <> y.word),
norms AS (SELECT a AS word, sqrt(sum(weight * weight)) AS n FROM vectors GROUP BY a),
dots AS (SELECT p.word, p.neighbour, sum(x.weight * y.weight) AS d FROM pairs p JOIN vectors x ON x.a = p.word
         JOIN vectors y ON y.a = p.neighbour AND y.b = x.b GROUP BY ALL),
cosines AS (SELECT d.word, neighbour, round(d / (x.n * y.n), 9) AS cosine FROM dots d JOIN norms x ON x.word = d.word JOIN norms y ON y.word = d.neighbour),
ranked AS (SELECT *, row_number() OVER (PARTITION BY word ORDER BY cosine DESC, neighbour) AS rank FROM cosines WHERE cosine >= {similar})
SELECT word, neighbour, round(cosine, 6) AS cosine, rank FROM ranked WHERE rank <= {most}"""


# --- entity links -------------------------------------------------------------------------------

def entity_ctes(rounds: int) -> str:
    """CTEs up to ``found`` (candidates), ``mentions`` and the ranks ``r0`` … after each round."""
    ctes = [f"""bench AS (SELECT item_id, {TOKENS} AS t FROM benchmark), tok AS MATERIALIZED (SELECT doc_id, {TOKENS} AS t FROM documents),
aliases AS MATERIALIZED (SELECT DISTINCT item_id AS entity, t[i] || ' ' || t[i + 1] AS alias FROM (SELECT item_id, t, unnest(range(1, len(t))) AS i FROM bench)),
hits AS (SELECT doc_id, i, t[i] || ' ' || t[i + 1] AS mention FROM (SELECT doc_id, t, unnest(range(1, len(t))) AS i FROM tok)),
places AS (SELECT doc_id, list({{'e': i::BIGINT, 'm': [mention]}} ORDER BY i) AS c FROM hits WHERE mention IN (SELECT alias FROM aliases) GROUP BY doc_id),
chosen AS (SELECT doc_id, list_reduce(list_prepend({{'e': 0::BIGINT, 'm': []::VARCHAR[]}}, c),
           lambda a, x: CASE WHEN x.e >= a.e THEN {{'e': x.e + 2, 'm': list_append(a.m, x.m[1])}} ELSE a END).m AS m FROM places),
mentions AS MATERIALIZED (SELECT doc_id AS doc, unnest(m) AS mention FROM chosen),
names AS (SELECT DISTINCT mention AS name FROM mentions UNION SELECT alias FROM aliases),
lettered AS MATERIALIZED (SELECT name, list_distinct(list_transform(range(1, length(name) + 1), lambda i: substring('^' || name || '$', i, 3))) AS g FROM names),
grams AS MATERIALIZED (SELECT name, len(g) AS size, unnest(g) AS gram FROM lettered),
pairs AS (SELECT a.name AS l, b.name AS r, count(*) / (any_value(a.size) + any_value(b.size) - count(*)) AS score FROM grams a JOIN grams b USING (gram)
          WHERE a.name IN (SELECT mention FROM mentions) AND b.name IN (SELECT alias FROM aliases) GROUP BY ALL HAVING score >= 0.6),
found AS MATERIALIZED (SELECT l AS mention, entity, max(score) AS score FROM pairs JOIN aliases ON r = alias GROUP BY ALL),
weights AS MATERIALIZED (SELECT doc, entity, sum(score) AS w FROM mentions JOIN found USING (mention) GROUP BY ALL),
edges AS MATERIALIZED (SELECT doc, entity, w / sum(w) OVER (PARTITION BY entity) AS to_doc, w / sum(w) OVER (PARTITION BY doc) AS to_entity FROM weights),
r0 AS (SELECT DISTINCT entity, 1.0 / (SELECT count(DISTINCT entity) FROM edges) AS rank FROM edges)"""]
    for k in range(1, rounds + 1):
        ctes.append(f"d{k} AS MATERIALIZED (SELECT doc, sum(rank * to_doc) AS s FROM edges JOIN r{k - 1} USING (entity) GROUP BY doc)")
        ctes.append(f"r{k} AS MATERIALIZED (SELECT entity, 0.15 / (SELECT count(DISTINCT entity) FROM edges) + 0.85 * sum(s * to_entity) AS rank "
                    f"FROM edges JOIN d{k} USING (doc) GROUP BY entity)")
    return ",\n".join(ctes)


# --- sentence vectors ---------------------------------------------------------------------------

TOKEN_WEIGHTS = f"""words AS MATERIALIZED (SELECT doc_id, unnest({TOKENS}) AS token FROM documents),
weights AS MATERIALIZED (SELECT token, count(*) / (SELECT count(*) FROM words) AS share FROM words GROUP BY token)"""


def sentence_vectors_sql(width: int, rounds: int) -> str:
    ctes = [TOKEN_WEIGHTS, f"vocabulary AS (SELECT DISTINCT unnest({TOKENS}) AS token FROM benchmark)",
            "vectors AS (SELECT token, embedding::DOUBLE[] AS v FROM vocabulary JOIN embeddings ON vec_id = 5 * length(token))",
            f"weighted AS MATERIALIZED (SELECT token, i - 1 AS i, v[i] * (0.001 / (0.001 + share)) AS x FROM vectors JOIN weights USING (token), range(1, {width + 1}) r(i))",
            "found AS MATERIALIZED (SELECT doc_id, i, avg(x) AS x FROM words JOIN weighted USING (token) GROUP BY ALL)",
            f"means AS MATERIALIZED (SELECT d.doc_id, r.i, coalesce(f.x, 0) AS x FROM documents d CROSS JOIN range({width}) r(i) "
            "LEFT JOIN found f ON f.doc_id = d.doc_id AND f.i = r.i)",
            f"u0 AS (SELECT i, 1 / sqrt({width}) AS u FROM range({width}) r(i))"]
    for k in range(1, rounds + 1):
        ctes.append(f"s{k} AS MATERIALIZED (SELECT doc_id, sum(x * u) AS s FROM means JOIN u{k - 1} USING (i) GROUP BY doc_id)")
        ctes.append(f"w{k} AS MATERIALIZED (SELECT i, sum(x * s) AS w FROM means JOIN s{k} USING (doc_id) GROUP BY i)")
        ctes.append(f"u{k} AS MATERIALIZED (SELECT i, w / sqrt((SELECT sum(w * w) FROM w{k})) AS u FROM w{k})")
    ctes.append(f"along AS MATERIALIZED (SELECT doc_id, sum(x * u) AS s FROM means JOIN u{rounds} USING (i) GROUP BY doc_id)")
    return ("WITH " + ",\n".join(ctes) + f"\nSELECT doc_id, i::INT AS at, round(x - u * s, 6) AS value FROM means JOIN u{rounds} USING (i) "
            "JOIN along USING (doc_id)")


# --- phrases ----------------------------------------------------------------------------------

def phrase_spans_sql() -> str:
    grams, marks = [], []
    for n in (2, 3, 4):
        joined = " || ' ' || ".join(f"t[i + {k}]" for k in range(n))
        marks.append(f"SELECT DISTINCT {joined} AS phrase, {n} AS size FROM (SELECT t, unnest(range(1, len(t) - {n - 2})) AS i FROM bench)")
        grams.append(f"SELECT doc_id, i - 1 AS begin, {n} AS size, {joined} AS phrase FROM (SELECT doc_id, t, unnest(range(1, len(t) - {n - 2})) AS i FROM tok)")
    return f"""WITH bench AS (SELECT {TOKENS} AS t FROM benchmark), tok AS MATERIALIZED (SELECT doc_id, {TOKENS} AS t FROM documents),
marks AS MATERIALIZED ({" UNION ALL ".join(marks)}), grams AS ({" UNION ALL ".join(grams)}),
hits AS MATERIALIZED (SELECT g.doc_id, g.begin, g.size FROM grams g JOIN marks m ON g.phrase = m.phrase AND g.size = m.size),
best AS (SELECT doc_id, begin, max(size) AS size FROM hits GROUP BY ALL),
lists AS (SELECT doc_id, list({{'e': size::BIGINT, 's': [begin::BIGINT]}} ORDER BY begin) AS c FROM best GROUP BY doc_id),
chosen AS (SELECT doc_id, list_reduce(list_prepend({{'e': 0::BIGINT, 's': []::BIGINT[]}}, c),
           lambda a, x: CASE WHEN x.s[1] >= a.e THEN {{'e': x.s[1] + x.e, 's': list_append(a.s, x.s[1])}} ELSE a END).s AS s FROM lists),
spans AS (SELECT doc_id, unnest(s) AS begin FROM chosen)
SELECT doc_id, begin::INT AS begin, size::INT AS size, array_to_string(t[begin + 1:begin + size], ' ') AS phrase, 'words_' || size AS label
FROM spans JOIN best USING (doc_id, begin) JOIN tok USING (doc_id)"""


# --- stemming ---------------------------------------------------------------------------------

# Fixed values of the published algorithm, written down here once more so that a wrong entry in the library shows.
PAIRS_2 = ("ational ate, tional tion, enci ence, anci ance, abli able, entli ent, izer ize, ization ize, ation ate, ator ate, alism al, aliti al, alli al, "
           "fulness ful, ousli ous, ousness ous, iveness ive, iviti ive, biliti ble, bli ble, ogi og, fulli ful, lessli less, li -")
PAIRS_3 = "ational ate, tional tion, alize al, icate ic, iciti ic, ical ic, ful -, ness -, ative -"
ENDINGS_4 = "al ance ence er ic able ible ant ement ment ent ism ate iti ous ive ize ion".split()
IRREGULAR = ("skis ski, skies sky, dying die, lying lie, tying tie, idly idl, gently gentl, ugly ugli, early earli, only onli, singly singl, sky sky, "
             "news news, howe howe, atlas atlas, cosmos cosmos, bias bias, andes andes, inning inning, innings inning, outing outing, outings outing, "
             "canning canning, cannings canning, herring herring, herrings herring, earring earring, earrings earring, proceed proceed, "
             "proceeds proceed, proceeded proceed, proceeding proceed, exceed exceed, exceeds exceed, exceeded exceed, exceeding exceed, "
             "succeed succeed, succeeds succeed, succeeded succeed, succeeding succeed")


def _pairs(text: str) -> dict[str, str]:
    """Suffix (or word) and what takes its place; the longest first, as the longest suffix counts."""
    table = {a: b.strip("-") for a, b in (pair.split() for pair in text.split(","))}
    return dict(sorted(table.items(), key=lambda x: -len(x[0])))


STEP2, STEP3, STEP4 = _pairs(PAIRS_2), _pairs(PAIRS_3), sorted(ENDINGS_4, key=len, reverse=True)


def _any(suffixes) -> str:
    return "(" + "|".join(suffixes) + ")$"


def _case(table: dict[str, str], key: str) -> str:
    return f"CASE {key} " + " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in table.items()) + " END"


def stems_of(source: str) -> str:
    """CTEs giving ``stems(token, stem)`` for the distinct tokens of ``source(token)``."""
    region = "[^aeiouy]*[aeiouy]+[^aeiouy]"
    short = "[^aeiouy][aeiouy][^aeiouywxY]$"
    cut = "left(w, length(w) - length(s))"
    in1, in2 = "length(w) - length(s) >= r1", "length(w) - length(s) >= r2"
    return f"""
s0 AS (SELECT token, regexp_replace(regexp_replace(token, '^y', 'Y'), '([aeiouy])y', '\\1Y', 'g') AS w FROM {source}),
s1 AS (SELECT *, length(regexp_extract(w, '^(gener|commun|arsen|{region})', 0)) AS h FROM s0),
s2 AS (SELECT token, w, CASE WHEN h > 0 THEN h ELSE length(w) END AS r1, CASE WHEN h > 0 AND
       regexp_matches(substring(w, h + 1), '^{region}') THEN h + length(regexp_extract(substring(w, h + 1), '^{region}', 0))
       ELSE length(w) END AS r2 FROM s1),
s3 AS (SELECT token, r1, r2, CASE WHEN w LIKE '%sses' THEN left(w, length(w) - 2)
       WHEN regexp_matches(w, '(ied|ies)$') THEN left(w, length(w) - CASE WHEN length(w) > 4 THEN 2 ELSE 1 END)
       WHEN regexp_matches(w, '(us|ss)$') THEN w
       WHEN regexp_matches(w, '[aeiouy].+s$') THEN left(w, length(w) - 1) ELSE w END AS w FROM s2),
s4 AS (SELECT *, regexp_extract(w, '{_any(("eedly", "ingly", "edly", "eed", "ing", "ed"))}', 0) AS s FROM s3),
s5 AS (SELECT token, r1, r2, s, s IN ('ingly', 'edly', 'ing', 'ed') AND regexp_matches({cut}, '[aeiouy]') AS gone,
       CASE WHEN s IN ('eed', 'eedly') THEN CASE WHEN {in1} THEN {cut} || 'ee' ELSE w END
       WHEN s <> '' AND regexp_matches({cut}, '[aeiouy]') THEN {cut} ELSE w END AS w FROM s4),
s6 AS (SELECT token, r1, r2, CASE WHEN NOT gone THEN w WHEN regexp_matches(w, '(at|bl|iz)$') THEN w || 'e'
       WHEN regexp_matches(w, '(bb|dd|ff|gg|mm|nn|pp|rr|tt)$') THEN left(w, length(w) - 1)
       WHEN length(w) <= r1 AND (regexp_matches(w, '{short}') OR regexp_matches(w, '^[aeiouy][^aeiouy]$')) THEN w || 'e'
       ELSE w END AS w FROM s5),
s7 AS (SELECT token, r1, r2, CASE WHEN length(w) > 2 AND regexp_matches(w, '[^aeiouy][yY]$')
       THEN left(w, length(w) - 1) || 'i' ELSE w END AS w FROM s6),
s8 AS (SELECT *, regexp_extract(w, '{_any(STEP2)}', 0) AS s FROM s7),
s9 AS (SELECT token, r1, r2, CASE WHEN s = '' OR NOT {in1} THEN w WHEN s = 'ogi' AND w NOT LIKE '%logi' THEN w
       WHEN s = 'li' AND NOT regexp_matches(w, '[cdeghkmnrt]li$') THEN w
       ELSE {cut} || {_case(STEP2, "s")} END AS w FROM s8),
s10 AS (SELECT *, regexp_extract(w, '{_any(STEP3)}', 0) AS s FROM s9),
s11 AS (SELECT token, r1, r2, CASE WHEN s = '' OR NOT {in1} OR (s = 'ative' AND NOT {in2}) THEN w
        ELSE {cut} || {_case(STEP3, "s")} END AS w FROM s10),
s12 AS (SELECT *, regexp_extract(w, '{_any(STEP4)}', 0) AS s FROM s11),
s13 AS (SELECT token, r1, r2, CASE WHEN s = '' OR NOT {in2} OR (s = 'ion' AND NOT regexp_matches(w, '[st]ion$'))
        THEN w ELSE {cut} END AS w FROM s12),
s14 AS (SELECT token, CASE WHEN w LIKE '%ll' AND length(w) - 1 >= r2 THEN left(w, length(w) - 1)
        WHEN w LIKE '%e' AND length(w) - 1 >= r2 THEN left(w, length(w) - 1)
        WHEN w LIKE '%e' AND length(w) - 1 >= r1 AND length(w) >= 4
        AND NOT regexp_matches(left(w, length(w) - 1), '{short}') THEN left(w, length(w) - 1) ELSE w END AS w FROM s13),
stems AS (SELECT token, coalesce({_case(_pairs(IRREGULAR), "token")},
          CASE WHEN length(token) <= 2 THEN token ELSE replace(w, 'Y', 'y') END) AS stem FROM s14)"""


VOCABULARY = f"vocabulary AS (SELECT DISTINCT unnest({TOKENS}) AS token FROM documents)"


def phrase_words(groups) -> list[str]:
    return sorted({w.lower() for ps in groups.values() for p in ps for w in p.split(" ") if w})


def listed(words) -> str:
    return "(VALUES " + ", ".join(f"({q(w)})" for w in words) + ")"


# --- votes ------------------------------------------------------------------------------------

def _longest(groups, used) -> int:
    return max(len(p.split(" ")) for g in used for p in groups[g])


def _gram_columns(longest: int) -> str:
    cols = ["t AS t1"]
    for n in range(2, longest + 1):
        joined = " || ' ' || ".join(f"t[i + {k}]" if k else "t[i]" for k in range(n))
        cols.append(f"list_transform(range(1, len(t) - {n} + 2), lambda i: {joined}) AS t{n}")
    return ", ".join(cols)


def _position(phrase: str, stemmed: bool) -> str:
    n = len(phrase.split(" "))
    value = q(phrase)
    if stemmed:
        parts = " || ' ' || ".join(
            f"(SELECT stem FROM phrase_stems WHERE word = {q(w.lower())})" if w else "''" for w in phrase.split(" "))
        value = f"({parts})"
    return f"coalesce(list_position(t{n}, {value}), 0) - 1"


def _groups_used(rules) -> list[str]:
    return list(dict.fromkeys(g for r in rules if r.kind == "near" for g in (r.left, r.right)))


def token_lists(source: str, keys: str, stemmed: bool) -> str:
    """CTEs giving ``tok(keys, text, low, t)`` with tokens or stems in text order."""
    if not stemmed:
        return f"tok AS (SELECT {keys}, text, lower(coalesce(text, '')) AS low, {TOKENS} AS t FROM {source})"
    return f"""raw AS (SELECT {keys}, text, {TOKENS} AS t FROM {source}),
vocabulary AS (SELECT DISTINCT unnest(t) AS token FROM raw
               UNION SELECT word FROM lexicon_words),
{stems_of("vocabulary")},
phrase_stems AS (SELECT word, stem FROM lexicon_words JOIN stems ON word = token),
spread AS (SELECT {keys}, unnest(t) AS token, unnest(range(len(t))) AS place FROM raw),
gathered AS (SELECT {keys}, list(stem ORDER BY place) AS t FROM spread JOIN stems USING (token) GROUP BY {keys}),
tok AS (SELECT {", ".join("raw." + k.strip() for k in keys.split(","))}, raw.text, lower(coalesce(raw.text, '')) AS low,
        coalesce(gathered.t, []) AS t FROM raw LEFT JOIN gathered USING ({keys}))"""


def distance_ctes(groups, rules, source: str, keys: str, stemmed: bool = False) -> str:
    """CTEs up to ``dist(keys, text, low, gap_…)``."""
    used = _groups_used(rules)
    ctes = []
    if stemmed:
        ctes.append(f"lexicon_words(word) AS {listed(phrase_words(groups))}")
    ctes.append(token_lists(source, keys, stemmed))
    ctes.append(f"gram AS MATERIALIZED (SELECT {keys}, text, low, {_gram_columns(_longest(groups, used) if used else 1)} FROM tok)")
    placed = [f"list_sort(list_filter([{', '.join(_position(p, stemmed) for p in groups[g])}], lambda x: x >= 0)) AS p_{g}"
              for g in used]
    ctes.append(f"pos AS MATERIALIZED (SELECT {', '.join([keys, 'text', 'low', *placed])} FROM gram)")
    pairs = list(dict.fromkeys((r.left, r.right) for r in rules if r.kind == "near"))
    gaps = [f"coalesce(list_min(list_transform(range(1, least(len(p_{a}), len(p_{b})) + 1), "
            f"lambda i: abs(p_{a}[i] - p_{b}[i]))), 999) AS gap_{a}_x_{b}" for a, b in pairs]
    ctes.append(f"dist AS (SELECT {', '.join([keys, 'text', 'low', *gaps])} FROM pos)")
    return ",\n".join(ctes)


def _fires(rule, groups) -> str:
    if rule.kind == "near":
        return f"gap_{rule.left}_x_{rule.right} < {rule.limit}"
    if rule.kind == "contains":
        return "(" + " OR ".join(f"contains(low, {q(p)})" for p in groups[rule.left]) + ")"
    return f"regexp_matches(low, {q(rule.regex)})"


def vote_ctes(groups, rules=None, source: str = "documents", keys: str = "doc_id", stemmed: bool = False) -> str:
    """CTEs up to ``voted(keys, text, votes)``."""
    rules = RULES if rules is None else rules
    primary = [r for r in rules if r.kind != "tally"]
    cols = [f"CASE WHEN {_fires(r, groups)} THEN {r.vote} ELSE 0 END AS v_{r.name}" for r in primary]
    fired = " + ".join(f"(v_{r.name} > 0)::INT" for r in primary)
    votes = ", ".join(f"CASE WHEN fired < {r.limit} THEN {r.vote} ELSE 0 END" if r.kind == "tally" else f"v_{r.name}"
                      for r in rules)
    return f"""{distance_ctes(groups, rules, source, keys, stemmed)},
base AS (SELECT {', '.join([keys, 'text', *cols])} FROM dist),
counted AS (SELECT *, {fired} AS fired FROM base),
voted AS MATERIALIZED (SELECT {keys}, text, [{votes}] AS votes FROM counted)"""


def long_ctes(rules, keys: str = "doc_id") -> str:
    names = "[" + ", ".join(q(r.name) for r in rules) + "]"
    return (f"long AS (SELECT {keys}, i - 1 AS rule_no, {names}[i] AS rule, votes[i] AS vote "
            f"FROM (SELECT {keys}, votes, unnest(range(1, {len(rules) + 1})) AS i FROM voted))")


DIGITS = "array_to_string(votes, '') AS votes"
VOTED = vote_ctes(sd.PHRASES)
GOLD_VOTED = f"{GOLD},\n{vote_ctes(sd.PHRASES, source='gold', keys='doc_id, class')}"
LONG = long_ctes(RULES)
GOLD_LONG = long_ctes(RULES, "doc_id, class")
TOTALS = """per_row AS (SELECT doc_id, count(*) FILTER (vote > 0) AS n_votes,
            count(DISTINCT CASE WHEN vote > 0 THEN vote END) AS n_labels FROM long GROUP BY doc_id)"""
SUMMARY = """rule_no, any_value(rule) AS rule,
coalesce(array_to_string(list_sort(list(DISTINCT vote) FILTER (vote > 0)), ','), '') AS polarity,
round(avg((vote > 0)::INT), 6) AS coverage,
round(avg((vote > 0 AND n_votes > 1)::INT), 6) AS overlaps,
round(avg((vote > 0 AND n_labels > 1)::INT), 6) AS conflicts"""
MAJORITY = """counts AS (SELECT doc_id, class, text, len(list_filter(votes, lambda v: v = 1)) AS c1,
              len(list_filter(votes, lambda v: v = 2)) AS c2, len(list_filter(votes, lambda v: v = 3)) AS c3 FROM voted),
majority AS (SELECT doc_id, class, text, CASE WHEN c1 >= c2 AND c1 >= c3 THEN 1 WHEN c2 >= c3 THEN 2 ELSE 3 END AS predicted
             FROM counts)"""
CONDITIONALS = f"""{GOLD_LONG},
combos AS (SELECT r.rule_no::INT AS rule_no, v.vote::INT AS vote, c.class::INT AS class FROM range({len(RULES)}) r(rule_no), range(4) v(vote), range(1, 4) c(class)),
seen AS (SELECT rule_no, vote, class, count(*) AS n FROM long WHERE class IS NOT NULL GROUP BY ALL),
sizes AS (SELECT class, count(*) AS n_class FROM gold WHERE class IS NOT NULL GROUP BY class),
conditionals AS (SELECT rule_no, vote, class, (coalesce(n, 0) + 1.0) / (coalesce(n_class, 0) + 4.0) AS p
                 FROM combos LEFT JOIN seen USING (rule_no, vote, class) LEFT JOIN sizes USING (class))"""
POSTERIORS = f"""{CONDITIONALS},
balance AS (SELECT class, n_class / (SELECT sum(n_class) FROM sizes) AS share FROM sizes),
cast_votes AS (SELECT doc_id, rule_no, vote FROM long WHERE vote > 0),
evidence AS (SELECT v.doc_id, c.class, sum(ln(c.p)) AS score FROM cast_votes v
             JOIN conditionals c USING (rule_no, vote) GROUP BY v.doc_id, c.class),
scores AS (SELECT g.doc_id, b.class, ln(b.share) + coalesce(e.score, 0) AS score
           FROM gold g CROSS JOIN balance b LEFT JOIN evidence e ON e.doc_id = g.doc_id AND e.class = b.class),
shifted AS (SELECT doc_id, class, exp(score - max(score) OVER (PARTITION BY doc_id)) AS w FROM scores),
proba AS (SELECT doc_id, class, w / sum(w) OVER (PARTITION BY doc_id) AS p FROM shifted)"""
POSTERIOR_ROW = """doc_id, round(max(p) FILTER (class = 1), 6) AS p_neutral, round(max(p) FILTER (class = 2), 6) AS p_negative,
round(max(p) FILTER (class = 3), 6) AS p_positive"""
CLASS_SCORES = """confusion AS (SELECT class AS gold, predicted, count(*) AS n FROM majority WHERE class IS NOT NULL GROUP BY ALL),
per_class AS (SELECT c.class::INT AS class, sum(CASE WHEN gold = c.class AND predicted = c.class THEN n ELSE 0 END)::BIGINT AS hits,
              sum(CASE WHEN gold <> c.class AND predicted = c.class THEN n ELSE 0 END)::BIGINT AS wrong,
              sum(CASE WHEN gold = c.class AND predicted <> c.class THEN n ELSE 0 END)::BIGINT AS missed,
              sum(CASE WHEN gold = predicted THEN n ELSE 0 END) / sum(n) AS accuracy
              FROM confusion, range(1, 4) c(class) GROUP BY c.class),
class_scores AS (SELECT *, coalesce(hits / nullif(hits + wrong, 0), 0) AS precision,
                 coalesce(hits / nullif(hits + missed, 0), 0) AS recall,
                 coalesce(2 * hits / nullif(2 * hits + wrong + missed, 0), 0) AS f1 FROM per_class)"""

# --- slices -----------------------------------------------------------------------------------

SLICED = f"""{GOLD_VOTED.replace("d.doc_id, d.lang, d.text", "d.doc_id, d.lang, d.n_chars, d.text")},
{MAJORITY},
facts AS (SELECT v.doc_id, v.class, m.predicted, g.lang, g.n_chars, list_filter(v.votes, lambda x: x > 0) AS c
          FROM voted v JOIN majority m USING (doc_id) JOIN gold g USING (doc_id)),
parts AS (SELECT doc_id, class, predicted, unnest(list_filter([CASE WHEN lang = 'en' THEN 'english' END, CASE WHEN lang = 'de' THEN 'german' END,
          CASE WHEN n_chars >= 2000 THEN 'long' END, CASE WHEN n_chars < 500 THEN 'short' END, CASE WHEN len(c) >= 10 THEN 'many_votes' END,
          CASE WHEN len(list_distinct(c)) > 1 THEN 'conflict' END], lambda s: s IS NOT NULL)) AS slice FROM facts)"""
SLICE_SCORES = """SELECT slice, class, hits, wrong, missed, round(coalesce(hits / nullif(hits + wrong, 0), 0), 6) AS precision,
round(coalesce(hits / nullif(hits + missed, 0), 0), 6) AS recall, round(coalesce(2 * hits / nullif(2 * hits + wrong + missed, 0), 0), 6) AS f1,
round(accuracy, 6) AS accuracy FROM (SELECT slice, k.class::INT AS class, count(*) FILTER (p.class = k.class AND predicted = k.class) AS hits,
count(*) FILTER (p.class <> k.class AND predicted = k.class) AS wrong, count(*) FILTER (p.class = k.class AND predicted <> k.class) AS missed,
avg((p.class = predicted)::INT) AS accuracy FROM parts p, range(1, 4) k(class) WHERE p.class IS NOT NULL GROUP BY ALL)"""

# --- rules as sentences -----------------------------------------------------------------------

def sentence_ctes(votes_of: str) -> str:
    """CTEs up to ``spoken(doc_id, rule_no, rule, vote)``; ``votes_of`` gives ``tok`` and ``dist`` of the near rule's groups."""
    checks = [
        ("has_license", 3, "contains(low, 'license') OR contains(low, 'ention')"),
        ("fines_near_funds", 2, "gap_negative_nouns_x_funds <= 8"),
        ("short_text", 1, f"len({TOKENS}) < 120 AND NOT contains(low, 'license')"),
        ("die_before_und", 2, "strpos(low, 'die') > 0 AND strpos(low, 'und') > strpos(low, 'die')"),
        ("many_budget_words", 3, f"len(list_filter({TOKENS}, lambda t: t IN ({', '.join(q(w) for w in sd.PHRASES['implementing'])}))) >= 6"),
        ("any_length", 1, f"len({TOKENS}) > 0"),
        ("long_text", 3, f"len({TOKENS}) > 300"),
        ("long_text_again", 3, f"len({TOKENS}) > 300 OR contains(low, 'no such words')"),
    ]
    each = " UNION ALL ".join(f"SELECT doc_id, {i} AS rule_no, {q(name)} AS rule, CASE WHEN {check} THEN {vote} ELSE 0 END AS vote FROM {votes_of}"
                              for i, (name, vote, check) in enumerate(checks))
    return f"spoken AS MATERIALIZED ({each})"


NEAR_SPOKEN = [lb.Rule("fines_near_funds", "near", lb.NEGATIVE, left="negative_nouns", right="funds", limit=9)]

# --- losses -----------------------------------------------------------------------------------

LOSSES = """raw AS (SELECT vec_id, label % 3 AS hard_label, [embedding[i]::DOUBLE * 10 for i in [1, 2, 3]] AS z,
            [abs(embedding[i]::DOUBLE) + 0.01 for i in [4, 5, 6]] AS m FROM embeddings),
soft AS (SELECT vec_id, hard_label, z, [x / list_sum(m) for x in m] AS t,
         ln(exp(z[1]) + exp(z[2]) + exp(z[3])) AS lse FROM raw),
losses AS (SELECT vec_id, t[1] * (lse - z[1]) + t[2] * (lse - z[2]) + t[3] * (lse - z[3]) AS soft,
           t[1] * (lse - z[1]) + t[2] * 2 * (lse - z[2]) + t[3] * 0.5 * (lse - z[3]) AS weighted,
           lse - z[hard_label + 1] AS hard FROM soft)"""


def _with(ctes: str, select: str) -> str:
    return f"WITH {ctes}\n{select}"




def all_oracles() -> dict[str, str]:
    near = [r for r in RULES if r.kind == "near"]
    substring = [r for r in RULES if r.kind == "contains"] + [lb.encourage_rule()]
    pattern = [lb.Rule("phrase_pattern", "pattern", lb.POSITIVE, regex=r"(the|and) [a-z]*tion[ ,.]"), lb.reduce_words_rule()]
    tallies = ", ".join(q(r.name) for r in RULES if r.kind == "tally")
    budget_like = [(g, p) for g in ("budgets", "encouraging") for p in sd.PHRASES[g]]
    gap_names = ", ".join(dict.fromkeys(f"gap_{r.left}_x_{r.right}" for r in near))
    header_free = "list_reduce(list_prepend(body, g), lambda a, x: replace(a, x, ''))"
    long_select = "SELECT doc_id, rule_no, rule, vote FROM long"

    o: dict[str, str] = {}
    o["inputs_by_suffix"] = "SELECT page_id, url FROM pages WHERE url LIKE '%.html'"
    o["output_paths"] = ("SELECT doc_id, replace(replace('../data/raw/' || source || '/raw-' || lang || '-' || doc_id || '.pdf', "
                         "'raw', 'processed'), '.pdf', '.txt') AS path FROM documents")
    digest = "SELECT vec_id, len(embedding)::INT AS width, round(list_sum(embedding::DOUBLE[]), 6) AS total FROM embeddings"
    o["matrix_scan"] = digest
    o["csv_round_trip"] = "SELECT doc_id, lang, text FROM documents"
    o["matrix_round_trip"] = digest
    o["text_sink_round_trip"] = _with(LINES, f"SELECT doc_id, {cleaned('text')} AS text FROM paragraphs")

    o["split_lines"] = _with(LINES, "SELECT doc_id, page, pos, line FROM lines")
    o["numbered_lines"] = _with(LINES, "SELECT doc_id, page, pos, line_no, line FROM numbered")
    o["lines_without_titles"] = _with(LINES, "SELECT doc_id, page, line_no, line FROM kept")
    o["title_counts"] = _with(LINES, "SELECT doc_id, count(*) FILTER (is_title) AS n_titles FROM flagged GROUP BY doc_id")
    o["page_paragraphs"] = _with(LINES, "SELECT doc_id, para_id, first_page, text FROM paragraphs")
    o["clean_page_paragraphs"] = _with(LINES, f"SELECT doc_id, para_id, first_page, {cleaned('text')} AS text FROM paragraphs")
    o["document_paragraphs"] = _with(DOC_LINES, "SELECT doc_id, para_id, text FROM paragraphs")
    o["clean_document_paragraphs"] = _with(
        f"{DOC_LINES},\n{TITLES},\nheaded AS (SELECT p.doc_id, para_id, list_reduce(list_prepend(p.text, g), "
        "lambda a, x: replace(a, x, '')) AS text FROM paragraphs p JOIN grams USING (doc_id))",
        f"SELECT doc_id, para_id, {cleaned('text')} AS text FROM headed")
    o["collapsed_blanks"] = f"SELECT doc_id, trim(regexp_replace(text, '{BLANKS}', ' ', 'g')) AS text FROM documents"
    o["title_words"] = (f"SELECT page_id, i - 1 AS at, w[i] AS word FROM (SELECT page_id, w, unnest(range(1, len(w) + 1)) AS i "
                        f"FROM (SELECT page_id, {path_words('url')} AS w FROM pages))")
    o["ngram_windows"] = (
        f"SELECT doc_id, len(g) AS n_windows, len(list_distinct(g)) AS n_distinct, g[1] AS first_window, g[len(g)] AS last_window "
        f"FROM (SELECT doc_id, list_transform(range(1, len(t) - 1), lambda i: t[i] || ' ' || t[i + 1] || ' ' || t[i + 2]) AS g "
        f"FROM (SELECT doc_id, {TOKENS} AS t FROM documents))")
    o["title_ngrams"] = _with(TITLES, "SELECT doc_id, i - 1 AS at, g[i] AS gram FROM "
                                      "(SELECT doc_id, g, unnest(range(1, len(g) + 1)) AS i FROM grams)")
    o["removed_headers"] = _with(TITLES, f"SELECT doc_id, {header_free} AS text FROM grams")
    o["stripped_brackets"] = "SELECT doc_id, regexp_replace(text, '[(\\[][^\\n]*?[)\\]]', '', 'g') AS text FROM documents"
    o["lowered_text"] = "SELECT doc_id, lower(text) AS text FROM documents"
    o["stripped_punctuation"] = f"SELECT doc_id, regexp_replace(text, '{PUNCTUATION}', '', 'g') AS text FROM documents"

    scored = "SELECT vec_id, round(results, 6) AS results FROM scored"
    o["similarity_scores"] = _with(SCORED, scored)
    o["similarity_filter"] = _with(SCORED, f"{scored} WHERE results >= 0.10")
    o["similarity_filter_default"] = _with(SCORED, f"{scored} WHERE results >= 0.40")
    o["similarity_band"] = _with(SCORED, f"{scored} WHERE results >= 0.10 AND results < 0.15")
    o["ranked_results"] = _with(SCORED, "SELECT label, vec_id, round(results, 6) AS results FROM scored WHERE results >= 0.10 "
                                        "ORDER BY label, scored.results DESC, vec_id")
    o["best_per_label"] = _with(
        f"{SCORED}, placed AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY results DESC, vec_id) AS rank FROM scored)",
        "SELECT label, vec_id, rank, round(results, 6) AS results FROM placed WHERE rank <= 5")
    pairs = ("SELECT a.vec_id AS query_id, b.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9) AS score "
             "FROM embeddings a, embeddings b WHERE a.vec_id % 100 = 0")
    o["query_neighbours"] = (f"SELECT query_id, vec_id, rank, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id "
                             f"ORDER BY score DESC, vec_id) AS rank FROM ({pairs})) WHERE rank <= 10")
    o["index_recall"] = "SELECT count(*) AS n_queries, TRUE AS enough FROM embeddings WHERE vec_id % 100 = 0"
    o["manual_labels"] = "SELECT d.doc_id, l.quality, l.toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"
    o["table_shape"] = ("SELECT (SELECT count(*) FROM documents) AS n_rows, (SELECT count(*) FROM (DESCRIBE documents)) AS n_columns")
    o["table_head"] = "SELECT doc_id, lang, text FROM documents ORDER BY doc_id LIMIT 5"
    o["default_class"] = _with(GOLD, "SELECT doc_id, coalesce(class, 1) AS class FROM gold")
    o["letter_codes"] = _with(GOLD, "SELECT doc_id, CASE class WHEN 1 THEN 'n' WHEN 2 THEN 'd' WHEN 3 THEN 'i' END AS letter, class FROM gold")
    o["corrected_labels"] = _with(GOLD, "SELECT g.doc_id, CASE WHEN l.toxic = 1 AND l.quality = 1 THEN 1 ELSE g.class END AS class "
                                        "FROM gold g LEFT JOIN labels l ON g.doc_id = l.doc_id")
    o["union_countries"] = _with(COUNTRIES, "SELECT country, doc_id, length(text) AS n_chars FROM countries")
    o["positional_join"] = ("SELECT position, vec_id, vec_label, doc_id, quality FROM "
                            "(SELECT vec_id, label AS vec_label, row_number() OVER (ORDER BY vec_id) - 1 AS position FROM embeddings) JOIN "
                            "(SELECT doc_id, quality, row_number() OVER (ORDER BY doc_id) - 1 AS position FROM labels) USING (position)")
    o["row_lookup"] = _with(f"{COUNTRIES}, placed AS (SELECT country, doc_id, text, row_number() OVER (ORDER BY country, doc_id) - 1 AS position FROM countries)",
                            "SELECT doc_id, text, country, position FROM placed WHERE position = 35")
    o["row_preview"] = _with(f"{GOLD}, placed AS (SELECT doc_id, class, text, row_number() OVER (ORDER BY doc_id) - 1 AS position FROM gold)",
                             "SELECT doc_id, class, text, position FROM placed WHERE position BETWEEN 50 AND 51")

    o["tokenized"] = f"SELECT doc_id, array_to_string({TOKENS}, ' ') AS tokens FROM documents"
    o["stemmed_vocabulary"] = _with(f"{VOCABULARY},{stems_of('vocabulary')}", "SELECT token, stem FROM stems")
    o["lexicon_forms"] = _with(
        f"lexicon_words(word) AS {listed(phrase_words(sd.PHRASES))},\n"
        f"texts AS (SELECT DISTINCT unnest({TOKENS}) AS token FROM documents),\n"
        f"vocabulary AS (SELECT token FROM texts UNION SELECT word FROM lexicon_words),{stems_of('vocabulary')}",
        "SELECT token, stem FROM stems WHERE token IN (SELECT token FROM texts) AND stem IN "
        "(SELECT stem FROM stems WHERE token IN (SELECT word FROM lexicon_words))")
    positions = " UNION ALL ".join(
        f"SELECT doc_id, {q(g)} AS group_name, {q(p)} AS phrase, {_position(p, False)} AS position FROM gram" for g, p in budget_like)
    o["phrase_positions"] = _with(
        f"{token_lists('documents', 'doc_id', False)}, gram AS MATERIALIZED (SELECT doc_id, {_gram_columns(max(len(p.split(' ')) for _, p in budget_like))} FROM tok)",
        f"SELECT * FROM ({positions}) WHERE position >= 0")
    o["pair_distances"] = _with(distance_ctes(sd.PHRASES, RULES, "documents", "doc_id"), f"SELECT doc_id, {gap_names} FROM dist")
    o["near_votes"] = _with(f"{vote_ctes(sd.PHRASES, near)},\n{long_ctes(near)}", long_select)
    o["contains_votes"] = _with(f"{vote_ctes(sd.PHRASES, substring)},\n{long_ctes(substring)}", long_select)
    o["tally_votes"] = _with(f"{VOTED},\n{LONG}", f"SELECT doc_id, rule, vote FROM long WHERE rule IN ({tallies})")
    o["pattern_votes"] = _with(f"{vote_ctes(sd.PHRASES, pattern)},\n{long_ctes(pattern)}", long_select)
    o["custom_votes"] = ("SELECT doc_id, 0 AS rule_no, 'long_text' AS rule, CASE WHEN length(text) > 500 THEN 2 ELSE 0 END AS vote FROM documents "
                         "UNION ALL SELECT doc_id, 1, 'quiet', CASE WHEN length(text) > 500 THEN 0 ELSE 1 END FROM documents")
    o["vote_matrix"] = _with(VOTED, f"SELECT doc_id, {DIGITS} FROM voted")
    o["vote_matrix_policy_phrases"] = _with(vote_ctes(lexicons.POLICY), f"SELECT doc_id, {DIGITS} FROM voted")
    stemmed = _with(vote_ctes(sd.PHRASES, stemmed=True), f"SELECT doc_id, {DIGITS} FROM voted")
    o["vote_matrix_stemmed"] = stemmed
    o["vote_matrix_stemmed_by_join"] = stemmed
    o["vote_matrix_policy_stemmed"] = _with(vote_ctes(lexicons.POLICY, stemmed=True), f"SELECT doc_id, {DIGITS} FROM voted")
    o["other_table_votes"] = _with(vote_ctes(sd.PHRASES, source="conversations", keys="conv_id, turn", stemmed=True),
                                   f"SELECT conv_id, turn, {DIGITS} FROM voted")
    o["paragraph_votes"] = _with(
        f"{LINES},\ncleaned AS (SELECT doc_id, para_id, {cleaned('text')} AS text FROM paragraphs),\n"
        + vote_ctes(sd.PHRASES, source="cleaned", keys="doc_id, para_id"), f"SELECT doc_id, para_id, {DIGITS} FROM voted")

    o["rule_coverage"] = _with(f"{VOTED},\n{LONG}", "SELECT rule_no, any_value(rule) AS rule, round(avg((vote > 0)::INT), 6) AS coverage "
                                                     "FROM long GROUP BY rule_no")
    o["lf_summary"] = _with(f"{VOTED},\n{LONG},\n{TOTALS}", f"SELECT {SUMMARY} FROM long JOIN per_row USING (doc_id) GROUP BY rule_no")
    defaulted = GOLD_VOTED.replace("END AS class FROM documents d", "ELSE 1 END AS class FROM documents d")
    o["lf_summary_gold"] = _with(
        f"{defaulted},\n{GOLD_LONG},\n{TOTALS}",
        f"""SELECT {SUMMARY}, count(*) FILTER (vote > 0 AND vote = class) AS correct,
count(*) FILTER (vote > 0 AND vote <> class) AS incorrect,
round(coalesce(count(*) FILTER (vote > 0 AND vote = class) / nullif(count(*) FILTER (vote > 0), 0), 0), 6) AS accuracy
FROM long JOIN per_row USING (doc_id) GROUP BY rule_no""")
    o["label_coverage"] = _with(VOTED, "SELECT round(avg((list_max(votes) > 0)::INT), 6) AS coverage FROM voted")
    o["vote_patterns"] = _with(VOTED, f"SELECT {DIGITS}, count(*) AS n FROM voted GROUP BY ALL")
    o["majority_vote"] = _with(f"{GOLD_VOTED},\n{MAJORITY}", "SELECT doc_id, predicted FROM majority")
    o["class_balance"] = _with(GOLD, "SELECT class, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM gold "
                                     "WHERE class IS NOT NULL GROUP BY class")
    o["vote_moments"] = _with(
        f"{VOTED},\n{LONG}",
        "SELECT a.rule_no AS rule_i, a.vote AS vote_i, b.rule_no AS rule_j, b.vote AS vote_j, "
        "round(count(*) / (SELECT count(*) FROM documents), 6) AS p FROM long a JOIN long b ON a.doc_id = b.doc_id AND a.rule_no <= b.rule_no "
        "WHERE a.vote > 0 AND b.vote > 0 GROUP BY ALL")
    o["vote_covariance"] = _with(
        f"{VOTED},\n{LONG},\ncast_votes AS (SELECT doc_id, rule_no, vote FROM long WHERE vote > 0),\n"
        "singles AS (SELECT rule_no, vote, count(*) / (SELECT count(*) FROM documents) AS p FROM cast_votes GROUP BY ALL),\n"
        "together AS (SELECT a.rule_no AS rule_i, a.vote AS vote_i, b.rule_no AS rule_j, b.vote AS vote_j, count(*) / (SELECT count(*) FROM documents) AS p "
        "FROM cast_votes a JOIN cast_votes b ON a.doc_id = b.doc_id GROUP BY ALL)",
        "SELECT a.rule_no AS rule_i, a.vote AS vote_i, b.rule_no AS rule_j, b.vote AS vote_j, round(coalesce(c.p, 0) - a.p * b.p, 6) AS covariance "
        "FROM singles a JOIN singles b ON a.rule_no < b.rule_no OR (a.rule_no = b.rule_no AND a.vote <= b.vote) "
        "LEFT JOIN together c ON c.rule_i = a.rule_no AND c.vote_i = a.vote AND c.rule_j = b.rule_no AND c.vote_j = b.vote")
    o["pair_vote_moments"] = _with(
        f"{VOTED},\n{LONG},\ncast_votes AS (SELECT doc_id, rule_no, vote FROM long WHERE vote > 0)",
        'SELECT a.rule_no AS "left", b.rule_no AS "right", a.vote AS vote_left, b.vote AS vote_right, c.rule_no AS rule, c.vote, '
        "round(count(*) / (SELECT count(*) FROM documents), 6) AS p FROM cast_votes a JOIN cast_votes b ON a.doc_id = b.doc_id "
        "AND b.rule_no = a.rule_no + 1 JOIN cast_votes c ON c.doc_id = a.doc_id AND c.rule_no <> a.rule_no AND c.rule_no <> b.rule_no "
        "WHERE a.rule_no < 20 AND a.rule_no % 2 = 0 GROUP BY ALL")
    o["fitted_shares"] = _with(
        f"{VOTED},\n{LONG}", "SELECT rule_no, vote, round(count(*) / (SELECT count(*) FROM documents), 6) AS share, TRUE AS close FROM long "
                             "WHERE vote > 0 GROUP BY ALL")
    o["vote_conditionals"] = _with(f"{GOLD_VOTED},\n{CONDITIONALS}", "SELECT rule_no, vote, class, round(p, 6) AS p FROM conditionals")
    o["posteriors"] = _with(f"{GOLD_VOTED},\n{POSTERIORS}", f"SELECT {POSTERIOR_ROW} FROM proba GROUP BY doc_id")
    o["stored_model_posteriors"] = o["posteriors"]
    o["predicted_classes"] = _with(
        f"{GOLD_VOTED},\n{POSTERIORS}, placed AS (SELECT doc_id, class, row_number() OVER (PARTITION BY doc_id ORDER BY p DESC, class) AS rank FROM proba)",
        "SELECT doc_id, class AS predicted FROM placed WHERE rank = 1")
    o["confusion_matrix"] = _with(f"{GOLD_VOTED},\n{MAJORITY}", "SELECT class AS gold, predicted, count(*) AS n FROM majority "
                                                                "WHERE class IS NOT NULL GROUP BY ALL")
    scores_row = ("SELECT class, hits, wrong, missed, round(precision, 6) AS precision, round(recall, 6) AS recall, "
                  "round(f1, 6) AS f1, round(accuracy, 6) AS accuracy FROM class_scores")
    o["class_scores"] = _with(f"{GOLD_VOTED},\n{MAJORITY},\n{CLASS_SCORES}", scores_row)
    o["f1_summary"] = _with(f"{GOLD_VOTED},\n{MAJORITY},\n{CLASS_SCORES}",
                            "SELECT round(avg(f1), 6) AS f1_macro, round(sum(f1 * (hits + missed)) / sum(hits + missed), 6) AS f1_weighted FROM class_scores")
    o["label_histogram"] = _with(
        f"{GOLD_VOTED},\n{MAJORITY}, g AS (SELECT class, count(*) AS n_gold FROM majority WHERE class IS NOT NULL GROUP BY class), "
        "p AS (SELECT predicted AS class, count(*) AS n_predicted FROM majority GROUP BY predicted)",
        "SELECT class, coalesce(n_gold, 0) AS n_gold, coalesce(n_predicted, 0) AS n_predicted FROM g FULL OUTER JOIN p USING (class)")
    o["probability_histogram"] = _with(
        f"{GOLD_VOTED},\n{POSTERIORS}", "SELECT class, least(floor(round(p, 6) * 20)::INT + 1, 20) AS bin, count(*) AS n FROM proba GROUP BY ALL")
    model = (f"{GOLD_VOTED},\n{POSTERIORS}, placed AS (SELECT doc_id, class, row_number() OVER (PARTITION BY doc_id ORDER BY p DESC, class) AS rank FROM proba), "
             "majority AS (SELECT g.doc_id, g.class, p.class AS predicted FROM gold g JOIN placed p ON g.doc_id = p.doc_id AND rank = 1)")
    o["model_class_scores"] = _with(f"{model},\n{CLASS_SCORES}", scores_row)
    o["model_label_histogram"] = _with(
        f"{model}, g AS (SELECT class, count(*) AS n_gold FROM majority WHERE class IS NOT NULL GROUP BY class), "
        "p AS (SELECT predicted AS class, count(*) AS n_predicted FROM majority GROUP BY predicted)",
        "SELECT class, coalesce(n_gold, 0) AS n_gold, coalesce(n_predicted, 0) AS n_predicted FROM g FULL OUTER JOIN p USING (class)")
    o["model_false_negatives"] = _with(model, "SELECT doc_id, class, predicted FROM majority WHERE class <> predicted AND class = 2")
    o["labeling_errors"] = _with(f"{GOLD_VOTED},\n{MAJORITY}", "SELECT doc_id, class, predicted FROM majority WHERE class <> predicted")
    o["false_negatives"] = _with(f"{GOLD_VOTED},\n{MAJORITY}", "SELECT doc_id, text, class, predicted FROM majority WHERE class <> predicted AND class = 2")
    o["missed_positives"] = _with(f"{GOLD_VOTED},\n{MAJORITY}", "SELECT doc_id, text, class, predicted FROM majority WHERE class <> predicted AND class = 3")

    o["paragraph_states"] = f"WITH RECURSIVE {state_ctes(sd.STATES)}\nSELECT doc_id, t AS para_id, " + ", ".join(
        f"round(g{i}, 6) AS p_{i}" for i in range(sd.STATES.n_states)) + " FROM gamma"
    spoken = f"{distance_ctes(sd.PHRASES, NEAR_SPOKEN, 'documents', 'doc_id')},\n{sentence_ctes('dist')}"
    o["sentence_rule_votes"] = _with(spoken, "SELECT doc_id, rule_no, rule, vote FROM spoken")
    both = distance_ctes(sd.PHRASES, NEAR_SPOKEN, "documents", "doc_id")
    for name in ("tok", "gram", "pos", "dist"):
        both = re.sub(rf"\b{name}\b", f"{name}_spoken", both)
    o["sentence_rule_report"] = _with(
        f"{GOLD_VOTED},\n{MAJORITY},\n{both},\n{sentence_ctes('dist_spoken')},\n"
        "facts AS (SELECT rule_no, any_value(rule) AS rule, avg((vote > 0)::INT) AS coverage, avg((vote = predicted)::INT) FILTER (vote > 0) AS agreement, "
        "list(vote ORDER BY doc_id) AS every FROM spoken JOIN majority USING (doc_id) GROUP BY rule_no), "
        "twins AS (SELECT a.rule_no, min(b.rule_no) AS same_as FROM facts a JOIN facts b ON a.every = b.every AND b.rule_no < a.rule_no GROUP BY a.rule_no)",
        "SELECT rule_no, rule, round(coverage, 6) AS coverage, round(agreement, 6) AS agreement, same_as, "
        "coverage BETWEEN 0.001 AND 0.98 AND same_as IS NULL AND coalesce(agreement, 1) >= 0.3 AS kept FROM facts LEFT JOIN twins USING (rule_no)")
    o["word_information"] = f"WITH {WORD_INFORMATION} SELECT a, b, round(weight, 6) AS weight FROM vectors"
    o["word_neighbours"] = word_neighbours_sql(8, 6, 5, 0.2)
    o["entity_candidates"] = _with(entity_ctes(0), "SELECT mention, entity, round(score, 6) AS score FROM found")
    o["entity_ranks"] = _with(entity_ctes(3), "SELECT entity, round(rank, 8) AS rank FROM r3")
    o["entity_links"] = _with(
        f"{entity_ctes(3)}, best AS (SELECT mention, entity, score, row_number() OVER (PARTITION BY mention ORDER BY round(score * rank, 15) DESC, entity) AS place "
        "FROM found JOIN r3 USING (entity))",
        "SELECT doc AS doc_id, mention, count(*) AS n, entity, round(score, 6) AS score FROM mentions LEFT JOIN (SELECT * FROM best WHERE place = 1) "
        "USING (mention) GROUP BY ALL")
    o["token_weights"] = f"WITH {TOKEN_WEIGHTS} SELECT token, round(share, 6) AS share, round(0.001 / (0.001 + share), 6) AS weight FROM weights"
    o["sentence_vectors"] = sentence_vectors_sql(64, 3)
    o["phrase_spans"] = phrase_spans_sql()
    o["slice_scores"] = _with(SLICED, SLICE_SCORES)
    order = "CASE {0}.slice " + " ".join(f"WHEN '{x}' THEN {i}" for i, x in enumerate(
        ("english", "german", "long", "short", "many_votes", "conflict"))) + " END"
    o["slice_overlaps"] = _with(SLICED, 'SELECT a.slice AS "left", b.slice AS "right", count(*) AS n FROM parts a JOIN parts b ON a.doc_id = b.doc_id '
                                        f"AND {order.format('a')} <= {order.format('b')} GROUP BY ALL")
    o["slice_weights"] = _with(
        f"{SLICED}, judged AS (SELECT doc_id, (class <> predicted)::INT AS wrong FROM facts WHERE class IS NOT NULL), "
        "residuals AS (SELECT slice, avg(wrong) / (SELECT avg(wrong) FROM judged) - 1 AS residual FROM parts JOIN judged USING (doc_id) GROUP BY slice)",
        "SELECT doc_id, round(1 + coalesce(sum(greatest(residual, 0)), 0), 6) AS weight FROM judged LEFT JOIN parts USING (doc_id) "
        "LEFT JOIN residuals USING (slice) GROUP BY doc_id")
    o["topic_vocabulary"] = f"WITH {TOPIC_TERMS} SELECT place::INT AS place, term FROM chosen"
    o["topic_round"] = topic_round_sql(4, 2, 0.01)
    o["state_update"] = state_update_sql(sd.STATES, 0.001)

    o["truncated_words"] = "SELECT doc_id, array_to_string(string_split(text, ' ')[1:50], ' ') AS text FROM documents"
    short_tokens = TOKENS.replace("text", "array_to_string(string_split(text, ' ')[1:50], ' ')")
    o["truncated_tokens"] = f"SELECT doc_id, array_to_string(({short_tokens})[1:50], ' ') AS tokens FROM documents"
    o["token_features"] = _with(
        f"vocabulary AS (SELECT DISTINCT unnest({TOKENS}) AS token FROM benchmark),\n"
        "vectors AS (SELECT token, list_sum(embedding::DOUBLE[]) AS total FROM vocabulary JOIN embeddings ON vec_id = 5 * length(token)),\n"
        f"tok AS (SELECT doc_id, ({short_tokens})[1:50] AS t FROM documents),\n"
        "slots AS (SELECT doc_id, i - 1 AS place, t[i] AS token FROM (SELECT doc_id, t, unnest(range(1, 51)) AS i FROM tok))",
        "SELECT doc_id, place AS at, round(coalesce(total, 0), 6) AS total FROM slots LEFT JOIN vectors USING (token)")
    o["model_features"] = _with(
        "cut AS (SELECT doc_id, string_split(text, ' ')[1:50] AS w FROM documents)",
        "SELECT doc_id, i - 1 AS at, CASE WHEN i <= len(w) THEN length(w[i]) + i - 1 ELSE 0 END::DOUBLE AS total "
        "FROM (SELECT doc_id, w, unnest(range(1, 51)) AS i FROM cut)")
    o["stacked_features"] = "SELECT vec_id, 8 AS n_rows, len(embedding)::INT AS n_values FROM embeddings ORDER BY vec_id"
    o["reshaped_features"] = ("SELECT vec_id, i AS at, round(list_sum(embedding[i * 8 + 1:i * 8 + 8]::DOUBLE[]), 6) AS total "
                              "FROM (SELECT vec_id, embedding, unnest(range(8)) AS i FROM embeddings)")
    only_labels = "labels_class AS (SELECT doc_id, CASE WHEN toxic = 1 THEN 2 WHEN quality = 1 THEN 3 ELSE 1 END AS class FROM labels)"
    o["zero_based_class"] = _with(only_labels, "SELECT doc_id, class - 1 AS class FROM labels_class")
    o["feature_labels"] = _with(only_labels, "SELECT doc_id, class, len(embedding)::INT AS width FROM embeddings JOIN labels_class ON vec_id = doc_id")
    o["train_split"] = _with(only_labels, "SELECT doc_id, class FROM labels_class WHERE doc_id >= 0 AND doc_id < 800")
    o["validation_split"] = _with(only_labels, "SELECT doc_id, class FROM labels_class WHERE doc_id >= 800 AND doc_id < 1000")
    o["noisy_train_split"] = "SELECT doc_id, lang FROM documents WHERE doc_id >= 0 AND doc_id < 15000"
    o["noisy_validation_split"] = _with(only_labels, "SELECT doc_id, class FROM labels_class WHERE doc_id >= 0 AND doc_id < 1000")
    o["row_losses"] = _with(LOSSES, "SELECT vec_id, round(soft, 6) AS soft, round(weighted, 6) AS weighted, round(hard, 6) AS hard FROM losses")
    o["loss_reductions"] = _with(LOSSES, " UNION ALL ".join(
        f"SELECT '{c}' AS loss, '{n}' AS reduction, round({f}({c}), 6) AS value FROM losses"
        for c in ("soft", "weighted", "hard") for n, f in (("mean", "avg"), ("sum", "sum"))))
    o["batched_validation_loss"] = _with(
        f"{LOSSES}, placed AS (SELECT hard, (row_number() OVER (ORDER BY vec_id) - 1) // 50 AS batch FROM losses), "
        "means AS (SELECT avg(hard) AS m FROM placed GROUP BY batch)", "SELECT round(avg(m), 6) AS val_loss FROM means")
    held_out = (f"{only_labels}, gold AS (SELECT doc_id, class FROM labels_class JOIN documents USING (doc_id)), "
                "placed AS (SELECT *, row_number() OVER (ORDER BY doc_id) - 1 AS place, count(*) OVER () AS n FROM gold), "
                "judged AS (SELECT 'gold' AS experiment, doc_id, class FROM placed WHERE place >= floor(0.8 * n) "
                "UNION ALL SELECT 'noisy', doc_id, class FROM placed)")
    o["experiment_rows"] = _with(
        f"{held_out}, learned AS (SELECT 'gold' AS experiment, count(*) AS n_train FROM placed WHERE place < floor(0.8 * n) UNION ALL "
        "SELECT 'noisy', count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels_class))",
        "SELECT experiment, n_train, count(*) AS n_judged, 0 AS n_both FROM learned JOIN judged USING (experiment) GROUP BY ALL")
    o["experiment_checks"] = _with(held_out, "SELECT experiment, doc_id, class, TRUE AS adds_up, TRUE AS is_best, TRUE AS has_loss FROM judged")
    o["weighted_training_rows"] = _with(
        f"{GOLD_VOTED},\n{POSTERIORS}", "SELECT (class - 1)::DOUBLE AS label, count(*) AS n, round(sum(p), 6) AS weight FROM proba "
                                        "JOIN embeddings ON vec_id = doc_id WHERE p > 0 GROUP BY class")
    return o
