"""Winnowed fingerprints, with SQL functions only.

A text's code points give one rolling hash per `k` in a row: the next place's hash is the last one's, shifted by a bit,
with the new code point's value added by exclusive or, as in a gear hash; values fall out of the word at its upper end, so
bits from `k` on depend on `k` code points only. Arrays have no running state in SQL, so all places take the same steps
at once: hashes of 2, 4, 8 ... code points come from two neighbours of half as many, in log2 steps. Of every `window` hashes in a row the least is chosen, the
rightmost among equal ones, and kept with its position. So two texts that share `window + k - 1` code points in a row
share a chosen hash, in any script, and no choice is denser than it must be. Hash and position are packed in one long (33
bits, in signed order, and 31 bits, positions counted down), so the least long of a window is the winnowing rule itself. Long texts are cut
into overlapping parts, so that arrays stay small; the choice is that of the whole text.

An edited text is the beginnings of two texts. Which windows chose a hash follows from the choices alone, so what windows
within these beginnings choose is read off the texts' own fingerprints, and only windows across the seam are hashed.

The text that follows in doc_id order is found without a global sort: bounds of doc_id ranges come from one
percentile sketch, each range is ordered by a window of its own, and the first row of a range is also sent to the range
before it.

Defined cases: null text is empty and has the empty fingerprint; two empty fingerprints are alike (1.0); a text of fewer
than k code points counts as one gram; repeated doc_ids are ordered by a hash of their texts, null ones come first; a
single document follows itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import id_and_text, stored

K, WINDOW = 8, 64
LOW = (1 << 31) - 1
#: Windows of a text that are looked at together, and windows in a row that share most of their hashes.
PART, STEP = 1 << 15, 8
#: Documents in one range of doc_id; the number of ranges stays below MOST_RANGES.
RANGE_ROWS, MOST_RANGES = 2000, 20_000


def let(value: Column, body) -> Column:
    """body(value) with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _grams(text: Column, k: int) -> Column:
    """The packed hash of every k code points, with nulls for the last places; of a shorter text, one hash."""

    def packed(h: Column, i: Column) -> Column:
        return h.bitwiseOR(F.lit(LOW).cast("long")).bitwiseXOR(i)  # LOW - i, as all bits of LOW are set

    def doubled(half: Column, size: int, body) -> Column:
        return let(half, lambda v: F.transform(v, lambda x, i: body(F.shiftleft(x, size).bitwiseXOR(F.get(v, i + size)), i)))

    all_, size = F.transform(F.split(text, ""), lambda c: F.xxhash64(c)), 1
    while size < k:
        all_, size = doubled(all_, size, packed if 2 * size == k else lambda h, i: h), 2 * size
    return F.when(F.length(text) >= k, all_).otherwise(F.array(packed(F.xxhash64(text), F.lit(0))))


def _chosen(text: Column, k: int, window: int) -> Column:
    """For every STEP windows in a row, the least packed hashes of these windows; fewer hashes than a window are one window.

    Where the hashes that all STEP windows share hold one less than all others in them, it is the least of each. Those
    are most; the others are looked at one by one."""

    def of(grams: Column, n: Column) -> Column:
        at = lambda j, d: F.get(grams, j * STEP + d)
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(grams) - 1) / STEP).cast("int")), lambda j: F.least(*[at(j, d) for d in range(STEP)]))

        def step(b: Column, j: Column) -> Column:
            inner = [F.get(b, j + d) for d in range(1, window // STEP)]
            outer = F.array(*[at(j, d) for d in (*range(STEP), *range(window, window + STEP - 1))])  # a window has STEP of these in a row
            each = lambda x: let(outer, lambda o: F.transform(F.sequence(F.lit(1), F.least(F.lit(STEP), n - j * STEP)), lambda r: F.least(x, F.array_min(F.slice(o, r, F.lit(STEP))))))
            alone = lambda x: F.when((j * STEP + STEP <= n) & (x < F.get(b, j)) & (x < F.get(b, j + window // STEP)), F.array(x)).otherwise(each(x))
            return let(F.least(*inner) if len(inner) > 1 else inner[0], alone)

        return let(blocks, lambda b: F.transform(F.sequence(F.lit(0), F.floor((n - 1) / STEP).cast("int")), lambda j: step(b, j)))

    windows = F.greatest(F.length(text) - (k + window - 2), F.lit(1))
    return F.when(text != "", let(windows, lambda n: let(_grams(text, k), lambda grams: of(grams, n)))).otherwise(F.array().cast("array<array<bigint>>"))


def winnow(text: Column, k: int = K, window: int = WINDOW) -> Column:
    """Chosen longs in order of position: hash above bit 31, 2^31 - 1 - position below."""
    if k < 2 or k & (k - 1) or k > 32 or window < 2 * STEP or window % STEP:
        raise ValueError(f"k is a power of 2 up to 32, window a multiple of {STEP} from {2 * STEP} on")

    def part(j: Column) -> Column:
        steps = let(F.substring(text, j * PART + 1, F.lit(PART + k + window - 2)), lambda t: _chosen(t, k, window))
        return F.transform(F.array_distinct(F.flatten(steps)), lambda x: x - j * PART)

    parts = F.transform(F.sequence(F.lit(0), F.floor(F.greatest(F.length(text) - (k + window - 1), F.lit(0)) / PART).cast("int")), part)
    return F.array_distinct(F.flatten(parts))


def position(x: Column) -> Column:
    return F.lit(LOW).cast("long") - x.bitwiseAND(F.lit(LOW).cast("long"))


def of_first_windows(chosen: Column, windows: Column, window: int) -> Column:
    """What the first `windows` windows choose. A choice begins with the window in which it comes up, if its hash is no
    more than that of the choice before, or else with the first window that no longer holds that one."""

    def begins(x: Column, i: Column) -> Column:
        before = F.get(chosen, i - 1)
        enters = F.shiftright(x, 31) <= F.shiftright(before, 31)
        return F.when(i == 0, F.lit(0).cast("long")).when(enters, position(x) - (window - 1)).otherwise(position(before) + 1)

    return F.filter(chosen, lambda x, i: begins(x, i) < windows)


def hashes(chosen: Column) -> Column:
    return F.array_distinct(F.transform(chosen, lambda x: F.shiftrightunsigned(x, 31)))


def shown(chosen: Column) -> Column:
    """hash@position, the hash in hexadecimal, joined by blanks."""
    return F.array_join(F.transform(chosen, lambda x: F.concat(F.hex(F.shiftrightunsigned(x, 31)), F.lit("@"), position(x).cast("string"))), " ")


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two arrays of distinct hashes."""
    shared = F.size(F.array_intersect(a, b))
    return let(shared, lambda s: F.when(F.size(a) + F.size(b) == 0, 1.0).otherwise(s / (F.size(a) + F.size(b) - s)))


def fingerprints(df: DataFrame, k: int = K, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text, chosen array<long>: the fingerprint of every document."""
    return id_and_text(df, id_col, text_col).withColumn("chosen", winnow(F.col("text"), k, window))


def _ranges(ids: DataFrame) -> Column:
    """The range of a doc_id, from 0, by bounds that a percentile sketch of all ids gives."""
    n = min(ids.count() // RANGE_ROWS + 1, MOST_RANGES)
    found = ids.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)], max(10_000, 4 * n)).alias("b")).first()["b"] if n > 1 else None
    bounds = sorted(set(found or []))
    if not bounds:
        return F.lit(0)
    step = int(len(bounds) ** 0.5) + 1
    tops, blocks = F.lit(bounds[::step]), F.array(*[F.lit(bounds[i : i + step]) for i in range(0, len(bounds), step)])
    below = lambda bounds, x: F.size(F.filter(bounds, lambda b: b <= x))
    at = below(tops, F.col("doc_id"))
    return F.coalesce(F.when(at == 0, 0).otherwise((at - 1) * step + below(F.element_at(blocks, F.greatest(at, F.lit(1))), F.col("doc_id"))), F.lit(0))


def with_next(df: DataFrame, computed, carried: list[str], order: str = "h") -> DataFrame:
    """df (doc_id, text and `order`, which orders rows of one doc_id) with next_<c> for each carried column: that of the row
    that follows in ascending doc_id order, after the last row of the first. computed(df) adds columns that carried may
    name; it sees rows once they stand in order, so that only df is shuffled."""
    at = _ranges(df.select("doc_id"))
    rows = df.withColumn("p", at)
    firsts = stored(df.select("doc_id", at.alias("p")).groupBy("p").agg(F.min("doc_id").alias("first_id")), "firsts", keep=True)  # at most MOST_RANGES + 1 rows
    by = Window.orderBy("p")
    ghosts_of = firsts.withColumn("to", F.coalesce(F.lag("p").over(by), F.max("p").over(by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))))
    ghosts = rows.join(F.broadcast(ghosts_of), (rows["p"] == ghosts_of["p"]) & rows["doc_id"].eqNullSafe(ghosts_of["first_id"])).drop(ghosts_of["p"])
    ghosts = ghosts.groupBy("to").agg(F.min_by(F.struct(*df.columns), F.struct("p", order)).alias("r")).select(F.col("to").alias("p"), "r.*", F.lit(True).alias("ghost"))
    both = rows.withColumn("ghost", F.lit(False)).unionByName(ghosts)
    keys = [F.col("ghost"), F.col("doc_id").asc_nulls_first(), F.col(order)]
    ready = computed(both.repartition("p").sortWithinPartitions("p", *keys))
    within = Window.partitionBy("p").orderBy(*keys)
    return ready.select("*", *[F.lead(c).over(within).alias(f"next_{c}") for c in carried]).where("not ghost").drop("p", "ghost")


def compare_with_next(df: DataFrame, k: int = K, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document's fingerprint against those of its edited text and of the next document."""
    span = k + window - 1
    own = lambda rows: rows.withColumn("chosen", winnow(F.col("text"), k, window))
    both = with_next(id_and_text(df, id_col, text_col).withColumn("h", F.xxhash64("text")), own, ["text", "chosen"])
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    both = both.withColumn("q", n - half).withColumn("r", F.least(half, F.length("next_text")))
    seam = F.concat(F.substring(F.col("text"), F.greatest(F.col("q") - (span - 2), F.lit(1)), F.least(F.col("q"), F.lit(span - 1))), F.substring(F.col("next_text"), F.lit(1), F.least(F.col("r"), F.lit(span - 1))))
    moved = lambda chosen, by: F.transform(chosen, lambda x: x - by)
    across = F.when((F.col("q") >= span) & (F.col("r") == 0), F.array().cast("array<bigint>")).otherwise(moved(winnow(seam, k, window), F.greatest(F.col("q") - (span - 1), F.lit(0))))
    within = of_first_windows(F.col("chosen"), F.col("q") - (span - 1), window), moved(of_first_windows(F.col("next_chosen"), F.col("r") - (span - 1), window), F.col("q"))
    edited = F.concat(F.substring(F.col("text"), F.lit(1), F.col("q")), F.substring(F.col("next_text"), F.lit(1), F.col("r")))
    marked = both.select("doc_id", n.cast("long").alias("n_chars"), "chosen", "next_chosen", F.sha2(edited, 256).alias("edited_sha256"), F.array_distinct(F.concat(within[0], across, within[1])).alias("edited_chosen"))

    def judged(row: Column) -> Column:
        return F.struct(likeness(row["own"], row["edited"]).alias("near_edited"), likeness(row["own"], row["next"]).alias("near_next"), shown(row["edited_chosen"]).alias("edited_fingerprint"))

    near = let(F.struct(hashes(F.col("chosen")).alias("own"), F.col("edited_chosen"), F.col("next_chosen")), lambda r: let(F.struct(r["own"].alias("own"), r["edited_chosen"].alias("edited_chosen"), hashes(r["edited_chosen"]).alias("edited"), hashes(r["next_chosen"]).alias("next")), judged))
    out = marked.select("doc_id", "n_chars", "edited_sha256", shown(F.col("chosen")).alias("fingerprint"), near.alias("r"))
    return out.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "r.edited_fingerprint", "r.near_edited", "r.near_next")
