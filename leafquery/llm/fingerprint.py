"""Document fingerprints as invertible Bloom lookup sketches of paragraph digests, with DataFrame functions only.

A text is read as paragraphs: stretches up to a sentence or line end, long ones in steps of PARAGRAPH characters. Its
distinct digests go into a sketch: three subtables of WIDTH cells that hold a count, the xor of the digests and the xor
of their check hashes. That sketch, written as text, is the fingerprint. Two versions' cells subtract; a cell left with
one digest gives it up, which frees others, until nothing is left: what was peeled are the paragraphs that differ.

Where the fingerprints hold too many differences to be peeled, the pair is tried again with a larger sketch: two to FAN
times as many cells, as sketches of the same form, one for each value of a further hash of the digests. Only parts that
fail again grow further. So every sketch and every step on it is small, whatever the length of the text, and the
work grows with the number of paragraphs. It all happens within the row: arrays and higher-order functions, no join, no
aggregation and no shuffle but the one that brings each text together with the next one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafquery.llm.splitters import exact_splitters, with_part

PARAGRAPH = 160
_PIECE = rf"[^.!?\n]{{1,{PARAGRAPH}}}[.!?\n]*|[.!?\n]+"
#: Cells of each of the three subtables of a sketch. Text bytes meant for one part.
WIDTH, PART_BYTES, MOST_PARTS = 8, 6 << 20, 65_536
#: Parts that a part with too many differences goes into at most, and sizes tried. Most rounds of peeling. Differences
#: that a sketch may be expected to give up (a part that should hold more is parted again at once), and those meant for it.
FAN, MOST_TRIES, ROUNDS, LOAD, TARGET = 32, 16, 8, 13, 8

_NO_CELL = "named_struct('n', 0L, 'keys', 0L, 'checks', 0L)"
_NO_DIGESTS = "cast(array() as array<bigint>)"


def digests(text: Column) -> Column:
    """The distinct digests of a text's paragraphs; none for the empty text."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(_PIECE), F.lit(0)), lambda p: F.xxhash64(p)))


def _once(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with value computed once, however often `then` reads it."""
    return F.transform(F.array(value), then)[0]


def _check(key: Column) -> Column:
    return F.xxhash64(key, F.lit("check"))


def _placed(keys: Column, n: int, level: Column) -> Column:
    """Each digest with n (1 or -1), its check hash and `at`, a bit for its cell in each of the three subtables."""
    return F.transform(keys, lambda k: F.struct(k.alias("key"), F.lit(n).cast("long").alias("n"), _check(k).alias("check"), _bits(k, level).alias("at")))


def _bits(key: Column, level: Column) -> Column:
    low = lambda t: F.shiftrightunsigned(F.xxhash64(key, level), 16 * t).bitwiseAND(F.lit(WIDTH - 1).cast("long")).cast("int")
    one = [F.call_function("shiftleft", F.lit(1), low(t) + t * WIDTH) for t in range(3)]
    return one[0].bitwiseOR(one[1]).bitwiseOR(one[2])


def _scatter(cells: Column, placed: Column, sign: int) -> Column:
    """The sketch's cells after every placed digest was added to (sign 1) or taken from (-1) its three cells."""

    def add(c: Column, x: Column) -> Column:
        n = c["n"] + x["n"] if sign == 1 else c["n"] - x["n"]
        return F.struct(n.alias("n"), c["keys"].bitwiseXOR(x["key"]).alias("keys"), c["checks"].bitwiseXOR(x["check"]).alias("checks"))

    into = lambda cell, i: F.aggregate(placed, cell, lambda c, x: F.when(F.call_function("getbit", x["at"], i) == 1, add(c, x)).otherwise(c))
    if sign == 1:
        return F.transform(cells, into)
    return _once(F.aggregate(placed, F.lit(0), lambda m, x: m.bitwiseOR(x["at"])), lambda some: F.transform(cells, lambda cell, i: F.when(F.call_function("getbit", some, i) == 1, into(cell, i)).otherwise(cell)))


def _none() -> Column:
    return F.array_repeat(F.expr(_NO_CELL), 3 * WIDTH)


def sketch(keys: Column, level: Column) -> Column:
    """The cells of the sketch of distinct digests; level tells one placement from another."""
    return _once(_placed(keys, 1, level), lambda placed: _scatter(_none(), placed, 1))


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: F.struct((x["n"] - y["n"]).alias("n"), x["keys"].bitwiseXOR(y["keys"]).alias("keys"), x["checks"].bitwiseXOR(y["checks"]).alias("checks")))


def sketch_difference(a: Column, b: Column, level: Column) -> Column:
    """subtract(sketch(a), sketch(b)) in one pass: a's digests are added to the cells and b's taken out."""
    return _once(F.concat(_placed(a, 1, level), _placed(b, -1, level)), lambda placed: _scatter(_none(), placed, 1))


def peel(cells: Column, level: Column) -> Column:
    """rest (whether anything is left), in_a and in_b, the digests recovered, from the subtracted cells.

    Each round finds the digests of all cells that hold just one, each once, and then takes them out, until there are
    none."""

    def state(cells: Column, now: Column, got: Column, stuck: Column) -> Column:
        return F.struct(cells.alias("cells"), now.alias("now"), got.alias("got"), stuck.alias("stuck"))

    def turn(s: Column, k: Column) -> Column:
        pure = lambda n: F.array_distinct(F.transform(F.filter(s["cells"], lambda c: (c["n"] == n) & (c["checks"] == _check(c["keys"]))), lambda c: c["keys"]))
        found = state(s["cells"], F.concat(_placed(pure(1), 1, level), _placed(pure(-1), -1, level)), s["got"], s["stuck"])
        taken = F.when(F.size(s["now"]) == 0, state(s["cells"], s["now"], s["got"], F.lit(True))).otherwise(state(_scatter(s["cells"], s["now"], -1), F.expr(none), F.concat(s["got"], s["now"]), s["stuck"]))
        return F.when(s["stuck"], s).when(k % 2 == 0, found).otherwise(taken)

    none = "cast(array() as array<struct<key:bigint,n:bigint,check:bigint,at:int>>)"
    side = lambda s, n: F.transform(F.filter(s["got"], lambda x: x["n"] == n), lambda x: x["key"])
    left = lambda s: F.exists(s["cells"], lambda c: (c["n"] != 0) | (c["keys"] != 0) | (c["checks"] != 0))
    return F.aggregate(F.sequence(F.lit(0), F.lit(2 * ROUNDS - 1)), state(cells, F.expr(none), F.expr(none), F.lit(False)), turn, lambda s: F.struct(left(s).alias("rest"), side(s, 1).alias("in_a"), side(s, -1).alias("in_b")))


def differences(a: Column, b: Column, cells_a: Column, cells_b: Column, tries: int = MOST_TRIES) -> Column:
    """in_a and in_b: the digests, ascending, that only one of two arrays of distinct digests has. cells_a and cells_b
    are their sketches of level 0, which come first; then parts of growing number, as far as they are needed.

    A part that all sizes do not solve is compared directly; that takes several digests that agree in 21 bits, as no
    text of fewer than some ten million paragraphs should have."""
    none = _NO_DIGESTS
    part = lambda x, y: F.struct(x.alias("a"), y.alias("b"))

    def split(p: Column, level: Column, share: Column) -> Column:
        """The parts of a part, two to FAN, by a hash of the digests that belongs to the level."""
        fan = F.greatest(F.lit(2), F.least(F.lit(FAN), F.ceil((F.size(p["a"]) + F.size(p["b"])) * share / TARGET))).cast("long")

        def cut(x: Column) -> Column:  # x: the part and into how many it goes
            take = lambda ds, k: F.filter(ds, lambda d: F.pmod(F.xxhash64(d, level), x["fan"]) == k)
            return F.transform(F.sequence(F.lit(0).cast("long"), x["fan"] - 1), lambda k: part(take(x["a"], k), take(x["b"], k)))

        return _once(F.struct(p["a"].alias("a"), p["b"].alias("b"), fan.alias("fan")), cut)

    def solve(parts: Column, level: Column, share: Column) -> Column:
        """For each part its digests and what peeling gave; parts that are too full for their cells are not tried."""
        size = lambda p: F.size(p["a"]) + F.size(p["b"])
        given = lambda rest: F.expr(f"named_struct('rest', {rest}, 'in_a', {none}, 'in_b', {none})")
        tried = lambda p: peel(sketch_difference(p["a"], p["b"], level), level)
        return F.transform(parts, lambda p: F.struct(p.alias("p"), F.when(size(p) == 0, given("false")).when(size(p) * share <= LOAD, tried(p)).otherwise(given("true")).alias("r")))

    def state(solved: Column, in_a: Column, in_b: Column, share: Column) -> Column:
        good = lambda side: F.flatten(F.transform(F.filter(solved, lambda x: ~x["r"]["rest"]), lambda x: x["r"][side]))
        return F.struct(
            F.transform(F.filter(solved, lambda x: x["r"]["rest"]), lambda x: x["p"]).alias("open"),
            F.concat(in_a, good("in_a")).alias("in_a"),
            F.concat(in_b, good("in_b")).alias("in_b"),
            share.alias("share"),
        )

    def start(cells: Column) -> Column:
        """How many of the fingerprints' cells cancel out tells which share of the digests differs; all if none does."""
        zero = F.size(F.filter(cells, lambda c: (c["n"] == 0) & (c["keys"] == 0)))
        guess = F.log(zero / F.lit(3.0 * WIDTH)) / F.log(F.lit(1 - 1 / WIDTH))
        share = F.when(zero == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), guess / F.greatest(F.lit(1), F.size(a) + F.size(b))))
        return state(F.array(F.struct(part(a, b).alias("p"), peel(cells, F.lit(0)).alias("r"))), F.expr(none), F.expr(none), share)

    first = _once(subtract(cells_a, cells_b), start)
    last = lambda share, level: F.when(level == tries - 1, F.lit(0.0)).otherwise(share)  # noqa: E731  the last size is tried whatever is expected
    grow = lambda s, level: F.when(F.size(s["open"]) == 0, s).otherwise(_once(solve(F.flatten(F.transform(s["open"], lambda p: split(p, level, s["share"]))), level, last(s["share"], level)), lambda solved: state(solved, s["in_a"], s["in_b"], s["share"])))

    def end(s: Column) -> Column:
        rest = lambda x, y: F.flatten(F.transform(s["open"], lambda p: F.array_except(p[x], p[y])))
        return F.struct(F.array_sort(F.concat(s["in_a"], rest("a", "b"))).alias("in_a"), F.array_sort(F.concat(s["in_b"], rest("b", "a"))).alias("in_b"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(tries - 1)), first, grow, end)


def as_text(cells: Column) -> Column:
    """A sketch as text: the number, count, digests and (16 bits of the) check hashes of each filled cell."""
    numbered = F.transform(cells, lambda c, i: F.struct(i.alias("i"), c.alias("c")))
    filled = F.filter(numbered, lambda x: (x["c"]["n"] != 0) | (x["c"]["keys"] != 0))
    return F.array_join(F.transform(filled, lambda x: F.format_string("%02x%x%016x%04x", x["i"], x["c"]["n"], x["c"]["keys"], x["c"]["checks"].bitwiseAND(0xFFFF))), ".")


def with_next(docs: DataFrame, carried: list[str] | None = None) -> DataFrame:
    """docs (doc_id, text and the columns carried): with next_text, the text of the row with the next lower id, and
    next_{column} of the others; after the last comes the first. Rows without an id come last."""
    carried = ["text", *(carried or [])]
    size = F.octet_length("text").cast("long") + 16
    weight = docs.agg(F.sum(size)).first()[0] or 0
    parts = max(1, min(MOST_PARTS, round(weight / PART_BYTES)))
    cuts = exact_splitters(docs.where("doc_id is not null"), F.col("doc_id"), size, [k / parts for k in range(1, parts)], [0.1 * weight / parts] * (parts - 1), bins=max(4096, 4 * parts))
    place = lambda df: with_part(df, F.col("doc_id"), cuts, "part").withColumn("part", F.coalesce("part", F.lit(0)).cast("int"))
    # each part's first row also stands, as a ghost, behind the last row of the part before it in descending order
    tops = place(docs.select("doc_id")).groupBy("part").agg(F.max("doc_id").alias("top")).where("top is not null").orderBy("part").collect()  # at most MOST_PARTS rows
    ghosts = [(r.top, tops[(k + 1) % len(tops)].part) for k, r in enumerate(tops)]
    look = docs.sparkSession.createDataFrame(ghosts, "top long, behind int")
    rows = place(docs).join(F.broadcast(look), F.col("doc_id") == F.col("top"), "left")
    here = F.struct(F.col("part").alias("part"), F.lit(False).alias("ghost"))
    rows = rows.withColumn("to", F.explode(F.when(F.col("behind").isNull(), F.array(here)).otherwise(F.array(here, F.struct(F.col("behind").alias("part"), F.lit(True).alias("ghost"))))))
    order = Window.partitionBy("part").orderBy("ghost", F.desc_nulls_last("doc_id"), F.xxhash64("text"))
    rows = rows.select("to.part", "to.ghost", "doc_id", *carried).repartitionById(parts, "part")  # one part to a task
    rows = rows.select("*", *[F.lead(c).over(order).alias(f"next_{c}") for c in carried]).where("not ghost")
    return rows.select("doc_id", *carried, *[F.coalesce(f"next_{c}", c).alias(f"next_{c}") for c in carried])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has its last floor(n_chars / 2) code points replaced by the first as many of the next document in
    descending order of the ids. Likeness is the share of common paragraphs among all of either text (1 if neither has
    any), from the paragraphs that peeling the subtracted fingerprints, or larger sketches where that fails, recovers.
    Null texts count as empty. Rows without an
    id come after all others; of repeated ids the order is that of a hash of the text; equal texts have equal
    fingerprints. Further columns are ignored. An empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.left("text", n - half), F.left("next_text", half))
    base = with_next(rows.withColumn("d0", digests(F.col("text"))).withColumn("s0", sketch(F.col("d0"), F.lit(0))), ["d0", "s0"]).withColumn("edited", edited)
    base = base.select("doc_id", n.cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), "d0", "s0", digests(F.col("edited")).alias("d1"), F.col("next_d0").alias("d2"), F.col("next_s0").alias("s2"))
    base = base.withColumn("s1", sketch(F.col("d1"), F.lit(0)))
    counts = lambda k: F.transform(F.array(differences(F.col("d0"), F.col(f"d{k}"), F.col("s0"), F.col(f"s{k}"))), lambda x: F.struct(F.size(x["in_a"]).alias("a"), F.size(x["in_b"]).alias("b")))[0]
    base = base.select("*", counts(1).alias("x1"), counts(2).alias("x2"))

    def likeness(k: int) -> Column:
        either = F.size("d0") + F.col(f"x{k}.b")
        return F.when(either == 0, F.lit(1.0)).otherwise((F.size("d0") - F.col(f"x{k}.a")) / either)

    return base.select("doc_id", "n_chars", "edited_sha256", as_text(F.col("s0")).alias("fingerprint"), as_text(F.col("s1")).alias("edited_fingerprint"), likeness(1).alias("near_edited"), likeness(2).alias("near_next"))
