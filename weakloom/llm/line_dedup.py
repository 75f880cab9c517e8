"""Line dedup by a segment-partition edit join, with DataFrame functions only.

A line goes when a line before it (by document id, then line number) is the same, or, for lines of ``min_chars``
and more, at most ``edits`` edits away. What is before a line is judged on the input, not on what is left.

Each line is cut into ``edits + 1`` cells, laid out for a size that lines of about one length share, the first half of them from the
line's start and the others from its end. Of two lines within the threshold some cell i holds no edit and has at most i edits to one
side and ``edits - i`` to the other, so its text is moved by the smaller of the two at most: the lines share a piece of that cell, looked at
in that many places and one more (multi-match-aware selection). A line has about five such pieces, and only pieces of two different lines matter.
Candidates whose lengths or letter counts, then whose three-character pieces differ by more than the edits
can change are dropped; the others are verified by a banded bit-parallel edit distance, which holds the
2 * edits + 1 diagonals of the matrix in the bits of two integers.

Lines are told apart by 128 bits of hash, and one table of hashes serves all steps: equal lines fold into one
row per task before anything is shuffled, so a line that a third of all documents share weighs nothing. Every piece is shuffled once, to find
those that two lines share. Bit sets of fixed size, broadcast as tables, then pick the lines that hold such pieces or lose a line (should they
fill up, more is shuffled; results stay). Texts are shuffled only for candidates and for documents that lose a line.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weakloom.functions.fence import fenced
from weakloom.llm.store import Scratch

EDITS = 2
MIN_CHARS = 24
#: Bits of the sets, as powers of two: of keys and lines (a table of 2**20 numbers) and of documents (a literal of 128 KB).
KEY_BITS = 26
SET_BITS = 20
#: Lengths that share a size, for lines of fewer than ``LONG`` characters and for others.
STEPS = (4, 16)
LONG = 64
_NO_ID = -(1 << 63)
#: Letters counted to tell lines apart before their texts are fetched.
LETTERS = ("etaoinsh", "rdlucmpg")
COUNTS = tuple(f"letters_{k}" for k in range(len(LETTERS)))
#: Characters in the pieces that two lines near each other must mostly share.
GRAM = 3


def _size(length: str, edits: int) -> str:
    """Size that the cells of a line with this length are laid out for; lines that differ by ``edits`` characters have one of two sizes."""
    short, far = (max(step, edits) for step in STEPS)
    return f"if({length} < {LONG}, {length} div {short} * {short}, {LONG} + ({length} - {LONG}) div {far} * {far})"


def _slack(edits: int) -> list[int]:
    """How far the text of each cell may have moved."""
    return [min(i, edits - i) for i in range(edits + 1)]


def _piece(size: str, edits: int) -> str:
    """Bytes of a piece in ``wide``, which has four per character, so that a piece is found without a walk to it."""
    return f"cast(greatest(0, ({size} - {sum(_slack(edits))}) div {edits + 1}) AS INT) * 4"


def _keys(size: str, piece: str, edits: int) -> str:
    """Hashes of the pieces of all cells, as an array, from the columns ``wide``, ``length`` and these two."""
    slack, found = _slack(edits), []
    for i, most in enumerate(slack):
        for shift in range(most + 1):
            start = f"{piece} * {i} + {4 * (sum(slack[:i]) + shift) + 1}"
            if 2 * i > edits:
                start = f"length * 4 - {piece} * {edits + 1 - i} - {4 * (sum(slack[i + 1:]) + shift) - 1}"
            found.append(f"xxhash64({size}, {i}, substring(wide, {start}, {piece}))")
    return f"array({', '.join(found)})"


def letter_counts(line: Column) -> list[Column]:
    """Counts of the ``LETTERS``, up to 255 each, eight in the bytes of an integer."""
    def count(letter: str) -> Column:
        return F.least(F.octet_length(line) - F.octet_length(F.replace(line, F.lit(letter), F.lit(""))), F.lit(255)).cast("bigint")

    packed = []
    for letters in LETTERS:
        value = F.lit(0).cast("bigint")
        for k, letter in enumerate(letters):
            value = value.bitwiseOR(F.shiftleft(count(letter), 8 * k))
        packed.append(value)
    return packed


def counts_allow(pairs: list[tuple[str, str]], edits: int) -> Column:
    """Whether letter counts differ by no more than ``edits`` edits can: two per edit."""
    difference = F.lit(0)
    for a, b in pairs:
        for k in range(8):
            byte_a, byte_b = (F.shiftrightunsigned(c, 8 * k).bitwiseAND(255) for c in (a, b))
            difference = difference + F.abs(byte_a - byte_b)
    return difference <= 2 * edits


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), body), 0)


def _right(value: Column, places: Column) -> Column:
    return F.call_function("shiftright", value, places.cast("int"))


def within(a: Column, b: Column, edits: int) -> Column:
    """Whether two texts are at most ``edits`` edits apart.

    ``a`` and ``b`` are arrays of characters that differ in length by at most ``edits`` and have at least
    ``edits`` characters. Bit d of the vectors is the cell of row ``j - edits + d`` in column j. Up to row m the
    lowest diagonal of the band is followed, then row m to its end.
    """
    width = 2 * edits + 1
    mask = (1 << width) - 1
    m, n = F.size(a), F.size(b)

    def step(s: Column, j: Column) -> Column:
        char = F.get(b, j - 1)
        equal = F.lit(0)
        for d in range(width):
            equal = equal + F.when(F.get(a, j - edits + d - 1) == char, 1 << d).otherwise(0)

        def with_equal(x: Column) -> Column:
            carried = ((x.bitwiseAND(s.up) + s.up).bitwiseXOR(s.up)).bitwiseOR(x).bitwiseOR(s.down)
            return _let(carried.bitwiseAND(mask), lambda diagonal: with_diagonal(diagonal))

        def with_diagonal(diagonal: Column) -> Column:
            right_up = s.down.bitwiseOR(F.bitwise_not(diagonal.bitwiseOR(s.up))).bitwiseAND(mask)
            right_down = diagonal.bitwiseAND(s.up)
            return _let(F.struct(diagonal.alias("d"), right_up.alias("u"), right_down.alias("v")), finish)

        def finish(h: Column) -> Column:
            below = F.shiftright(h.d, 1)
            row = m - j + edits  # bit of row m
            along = _right(h.u, row).bitwiseAND(1) - _right(h.v, row).bitwiseAND(1)
            down = 1 - F.shiftright(h.d, 2 * edits).bitwiseAND(1)
            return F.struct(
                h.v.bitwiseOR(F.bitwise_not(below.bitwiseOR(h.u))).bitwiseAND(mask).alias("up"),
                below.bitwiseAND(h.u).alias("down"),
                (s.distance + F.when(j + edits <= m, down).otherwise(along)).alias("distance"))

        return _let(equal, with_equal)

    # Column 0, seen from column 1: rows above the first have no difference, the others one each.
    first = ((1 << (edits + 1)) - 1) << edits
    start = F.struct(F.lit(first).alias("up"), F.lit(0).alias("down"), F.lit(edits).alias("distance"))
    return F.aggregate(F.sequence(F.lit(1), n), start, step, lambda s: s.distance <= edits)


def lines_of(docs: DataFrame, text: str = "text") -> DataFrame:
    """``doc_id, row, line_no, id, guard, line`` of all lines that are not blank; ``row`` stands for id and text of the document."""
    # The hash of the text is taken before the text is cut, or it would be taken for every line.
    whole = docs.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(_NO_ID)).alias("doc_id"), F.xxhash64("doc_id", text).alias("row"), F.col(text).alias("text"))
    cut = whole.select("doc_id", "row", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    spoken = cut.where(F.col("line").rlike(r"[^\x20\x09-\x0D]"))
    return spoken.select("doc_id", "row", "line_no", F.xxhash64("line").alias("id"), F.xxhash64("line", F.lit(1)).alias("guard"), "line")


def hashed_lines(docs: DataFrame, edits: int, min_chars: int, text: str) -> DataFrame:
    """The lines without their text, with the keys of those long enough.

    ``keys`` are those of the line's pieces for its own size; ``more`` those for the size of lines with up to ``edits`` characters less, if it is another.
    """
    lines = lines_of(docs, text).withColumn("length", F.char_length("line"))
    held = ["doc_id", "row", "line_no", "id", "guard"]
    wide = F.when(F.col("length") >= min_chars, F.encode("line", "UTF-32"))
    lines = lines.select(*held, "length", wide.alias("wide"), F.expr(_size("length", edits)).alias("size"),
                         F.expr(_size(f"greatest(length - {edits}, {min_chars})", edits)).alias("smaller"))
    # In steps: one large projection is too long for the compiler of the virtual machine.
    lines = lines.select(*held, "length", "wide", "size", "smaller", F.expr(_piece("size", edits)).alias("piece"), F.expr(_piece("smaller", edits)).alias("less"))
    has = F.col("wide").isNotNull()
    lines = lines.select(*held, "length", "wide", "size", "smaller", "less", F.when(has, F.expr(_keys("size", "piece", edits))).alias("keys"))
    return lines.select(*held, "keys", F.when(has & (F.col("size") != F.col("smaller")), F.expr(_keys("smaller", "less", edits))).alias("more"))


def _place() -> Column:
    """Document and line number as one number that a hash aggregation can take the smallest of."""
    return (F.col("doc_id").cast("decimal(20,0)") * F.lit(1 << 31).cast("decimal(10,0)") + F.col("line_no")).cast("decimal(38,0)")


def _bit(hashed: Column, bits: int) -> Column:
    return F.shiftrightunsigned(hashed, 64 - bits)


def bit_table(rows: DataFrame, column: str, bits: int = KEY_BITS) -> DataFrame:
    """``word, bits``: a set of hashes as at most ``2**(bits - 6)`` rows."""
    return rows.select(_bit(F.col(column), bits).alias("bit")).groupBy(F.shiftright("bit", 6).cast("int").alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 AS INT))")).alias("bits"))


def members(rows: DataFrame, column: str, table: DataFrame, bits: int = KEY_BITS) -> DataFrame:
    """The rows whose hash may be in the set. The broadcast table has a fixed largest size."""
    bit = _bit(F.col(column), bits)
    found = rows.withColumn("word", F.shiftright(bit, 6).cast("int")).join(F.broadcast(table), "word")
    return found.where(F.call_function("shiftrightunsigned", F.col("bits"), bit.bitwiseAND(63).cast("int")).bitwiseAND(1) == 1).drop("word", "bits")


def entries(lines: DataFrame) -> DataFrame:
    """``key, id`` of the pieces that different lines share (and of some others)."""
    both = F.when(F.col("more").isNull(), F.col("keys")).otherwise(F.concat("keys", "more"))
    every = lines.where("keys is not null").select("id", F.explode(both).alias("key"))
    shared = every.groupBy("key").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low < high")
    return members(every, "key", bit_table(shared, "key")).select("key", "id").distinct()


def candidates(pieces: DataFrame, texts: DataFrame, edits: int) -> DataFrame:
    """``a, b``: ids of different lines that share a piece, and have the lengths and the letters for it."""
    held = ["length", *COUNTS]
    counted = pieces.join(texts.select("id", *held), "id")
    own = counted.withColumnsRenamed({c: f"own_{c}" for c in ("key", "id", *held)})
    # The counts are compared inside the join: variants of one line share pieces by the thousand.
    fit = (F.abs(F.col("length") - F.col("own_length")) <= edits) & counts_allow([(c, f"own_{c}") for c in COUNTS], edits)
    pairs = own.join(counted, (F.col("own_key") == F.col("key")) & (F.col("id") < F.col("own_id")) & fit)
    return pairs.select(F.col("id").alias("a"), F.col("own_id").alias("b")).distinct()


def grams(line: Column) -> Column:
    """Hashes of all pieces of ``GRAM`` characters."""
    places = F.sequence(F.lit(0), F.greatest(F.lit(0), F.char_length(line) - GRAM))
    return _let(F.encode(line, "UTF-32"),
                lambda wide: F.transform(places, lambda k: F.xxhash64(F.substring(wide, k * 4 + 1, F.lit(4 * GRAM)))))


def set_of(ids: DataFrame, column: str, bits: int = SET_BITS) -> Callable[[Column], Column]:
    """A test for membership in the ids, with a literal of fixed size; others may also pass."""
    place = _bit(F.col(column), bits)
    words = ids.select(place.alias("place")).groupBy(F.shiftright("place", 5).cast("int").alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(place & 31 AS INT))")).alias("bits"))
    data = bytearray(1 << (bits - 3))
    for row in words.collect():  # at most 2**(bits - 5) rows
        data[row.word * 4:row.word * 4 + 4] = int(row.bits).to_bytes(4, "little")
    literal = F.lit(bytes(data))

    def test(hashed: Column) -> Column:
        at = _bit(hashed, bits)
        byte = F.ascii(F.decode(F.substring(literal, (F.shiftright(at, 3) + 1).cast("int"), F.lit(1)), "ISO-8859-1"))
        return _right(byte, at.bitwiseAND(7)).bitwiseAND(1) == 1

    return test


def near_lines(scratch: Scratch, docs: DataFrame, lines: DataFrame, edits: int, text: str) -> DataFrame:
    """``id, guard`` of the lines that have a near line before them."""
    pieces = scratch.stored(entries(lines), "line-pieces")
    texts = members(lines_of(docs, text), "id", bit_table(pieces, "id")).groupBy("id", "guard", "line").agg(F.min(_place()).alias("first"))
    counts = [c.alias(n) for n, c in zip(COUNTS, letter_counts(F.col("line")))]
    texts = scratch.stored(texts.select("*", F.char_length("line").alias("length"), *counts), "candidate-lines")
    pairs = scratch.stored(candidates(pieces, texts, edits), "line-pairs")

    def side(name: str) -> DataFrame:
        return texts.select(F.col("id").alias(name), *[F.col(c).alias(f"{name}_{c}") for c in ("guard", "first", "line")])

    both = pairs.join(side("a"), "a").join(side("b"), "b").where(F.abs(F.char_length("a_line") - F.char_length("b_line")) <= edits)
    # Fenced, or the filters would cut the lines anew for every character. An edit changes ``GRAM`` pieces at most.
    held = ["a", "b", "a_guard", "b_guard", "a_first", "b_first"]
    cut = fenced(both, [*held, "a_line", "b_line"], {"a_grams": grams(F.col("a_line")), "b_grams": grams(F.col("b_line"))})
    lost = F.greatest(F.size(F.array_except("a_grams", "b_grams")), F.size(F.array_except("b_grams", "a_grams")))
    chars = fenced(cut.where(lost <= edits * GRAM), held, {"a_chars": F.split("a_line", ""), "b_chars": F.split("b_line", "")})
    near = chars.where(within(F.col("a_chars"), F.col("b_chars"), edits))
    later = F.col("a_first") > F.col("b_first")
    near = scratch.stored(near.select(F.when(later, F.col("a")).otherwise(F.col("b")).alias("id"),
                                      F.when(later, F.col("a_guard")).otherwise(F.col("b_guard")).alias("guard")).distinct(), "near-lines")
    scratch.drop(pieces, texts, pairs)
    return near


def repeated_lines(scratch: Scratch, docs: DataFrame, edits: int = EDITS, min_chars: int = MIN_CHARS, text: str = "text") -> DataFrame:
    """``_id, _row, _gone, _near``: numbers of the lines to go in each document, and how many of them have an edited line before them."""
    lines = scratch.stored(hashed_lines(docs, edits, min_chars, text), "hashed-lines")
    near = near_lines(scratch, docs, lines, edits, text)
    kinds = lines.groupBy("id", "guard").agg(F.min(_place()).alias("first"), F.count(F.lit(1)).alias("n"))
    judged = scratch.stored(kinds.join(near.withColumn("near", F.lit(True)), ["id", "guard"], "left").where("near or n > 1"), "judged-lines")
    own = members(lines.select("doc_id", "row", "line_no", "id", "guard"), "id", bit_table(judged, "id"))
    found = own.join(judged, ["id", "guard"]).withColumn("near", F.coalesce("near", F.lit(False)))
    gone = found.where(F.col("near") | (_place() != F.col("first"))).groupBy("doc_id", "row").agg(
        F.collect_set("line_no").alias("_gone"), F.size(F.collect_set(F.when(F.col("near"), F.col("line_no")))).alias("_near"))
    gone = scratch.stored(gone.withColumnsRenamed({"doc_id": "_id", "row": "_row"}), "lines-to-go")
    scratch.drop(lines, near, judged)
    return gone


def without_repeats(docs: DataFrame, edits: int = EDITS, min_chars: int = MIN_CHARS, text: str = "text") -> DataFrame:
    """``docs`` with the repeated lines taken out of ``text``, and ``n_lines, n_removed, n_near`` added.

    Lines are what ``\\n`` separates. Blank lines are never compared and stay. ``n_near`` counts removed lines that have an
    edited line before them. Null text stays null with 0 lines. Rows of one id are one document here, whose lines are ordered by number:
    at the same place both keep a line. Rows without an id come before all others. All rows stay; other
    columns are kept, but columns of the three names are replaced.
    """
    kept = docs.drop("n_lines", "n_removed", "n_near")
    given = kept.columns
    gone = repeated_lines(Scratch(docs.sparkSession), kept.select("doc_id", text), edits, min_chars, text)
    # Numbered names cannot clash with those used here.
    own = kept.toDF(*[f"c{i}" for i in range(len(given))])
    key, body = (f"c{[c.lower() for c in given].index(name.lower())}" for name in ("doc_id", text))
    row, doc_id = F.xxhash64(key, body), F.coalesce(F.col(key).cast("bigint"), F.lit(_NO_ID))
    touched = set_of(gone, "_row")(row)
    lines = F.split(body, "\n")

    def n_lines(cut: Column) -> Column:
        return F.when(F.col(body).isNull(), 0).otherwise(F.size(cut)).cast("bigint")

    zero = F.lit(0).cast("bigint")
    counts = ["n_lines", "n_removed", "n_near"]
    same = own.where(~touched).select("*", n_lines(lines).alias("n_lines"), zero.alias("n_removed"), zero.alias("n_near"))
    # The list of lines grows with the documents, so it is dealt out with them and not broadcast at any size.
    joined = own.where(touched).join(gone.hint("shuffle_hash"), (row == F.col("_row")) & (doc_id == F.col("_id")), "left")
    joined = joined.withColumn("_lines", lines)  # once, not for each line that stays
    stay = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), F.col("_gone"))
    left = F.when(F.col("_gone").isNull(), F.col(body)).otherwise(F.array_join(F.transform(stay, lambda i: F.get("_lines", i)), "\n"))
    # Fenced, or whoever filters by the text would put it together twice.
    changed = fenced(joined, [c for c in own.columns if c != body], {
        body: left, "n_lines": n_lines(F.col("_lines")), "n_removed": F.coalesce(F.size("_gone"), F.lit(0)).cast("bigint"),
        "n_near": F.coalesce("_near", F.lit(0)).cast("bigint")})
    return same.unionByName(changed).toDF(*given, *counts)
