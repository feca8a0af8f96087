"""Operator 9, document fingerprints by winnowing, in DataFrame functions only.

Words (runs between ASCII blanks) get 32 bits of their MD5; K neighbouring ones are combined to a rolling k-gram hash, the
polynomial in BASE modulo the prime MOD; every window of W consecutive k-grams gives its smallest hash, the rightmost of equal
ones. Any two texts that share W + K - 1 words in a row share a fingerprint entry; an entry keeps the k-gram's position.

The polynomial of K words is built from those of K / 2, and window minima from those of 2, 4, ... neighbours, so the work is a
few passes over an array. A hash and its position are packed in one long, (hash << 32) | (2**32 - 1 - position): the smallest
long is the smallest hash, rightmost. Positions have 32 bits, more than a string of two gigabytes has words.

Cases: null text is empty; an empty text or one of blanks has the empty fingerprint; a text of fewer than K words has its
whole sequence as its one k-gram, and one with fewer than W k-grams has one window; the likeness of two empty
fingerprints is 1; the next document goes by descending doc_id, nulls last, ties by text; repeated rows follow each other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K, W = 4, 8
BASE, MOD = 1_000_003, (1 << 31) - 1
POS_BITS = 32
POS_MASK = (1 << POS_BITS) - 1
RANGES = 64
RANGE_BYTES = 16 << 20
MOST_RANGES = 8192  # beyond 128 GB of text, ranges grow


def _next(a: str, by: int) -> str:
    """Array a without its first `by` elements."""
    return f"slice({a}, {by + 1}, greatest(size({a}) - {by}, 0))"


def _prefix(a: str, by: int) -> str:
    return f"slice({a}, 1, greatest(size({a}) - {by}, 0))"


def with_fingerprint(df: DataFrame, text: str, out: str) -> DataFrame:
    """df with the array of packed entries `out`; K and W are powers of two, reached by doubling."""
    keep = df.columns
    words = f"filter(split({text}, '[\\\\x20\\\\x09-\\\\x0D]+'), w -> w != '')"
    df = df.selectExpr(*keep, f"transform({words}, w -> cast(conv(left(md5(w), 8), 16, 10) as bigint)) _h")
    whole = f"array(aggregate(_h, 0L, (s, x) -> (s * {BASE}L + x) % {MOD}L))"
    step = lambda by: f"zip_with({_prefix('_g', by)}, {_next('_g', by)}, (x, y) -> (x * {pow(BASE, by, MOD)}L + y) % {MOD}L)"
    df = df.selectExpr(*keep, f"if(size(_h) = 0, _h, {whole}) _all", f"size(_h) < {K} _short", "_h _g")
    by = 1
    while by < K:
        df = df.selectExpr(*keep, "_all", "_short", f"{step(by)} _g")
        by *= 2
    df = df.selectExpr(*keep, f"transform(if(_short, _all, _g), (x, i) -> shiftleft(x, {POS_BITS}) | ({POS_MASK}L - i)) _g")
    df = df.selectExpr(*keep, "size(_g) _n", "_g")
    by = 1
    while by < W:
        df = df.selectExpr(*keep, "_n", f"zip_with(_g, {_next('_g', by)}, (x, y) -> least(x, y)) _g")
        by *= 2
    return df.selectExpr(*keep, f"array_distinct(slice(_g, 1, greatest(_n - {W - 1}, least(_n, 1)))) {out}")


def digest(packed: str) -> Column:
    """The fingerprint as text: `position:hash` in hexadecimal, in order of windows."""
    return F.expr(f"array_join(transform({packed}, x -> concat(lower(hex({POS_MASK}L - (x & {POS_MASK}L))), ':', lower(hex(shiftrightunsigned(x, {POS_BITS}))))), ' ')")


def likeness(a: str, b: str) -> Column:
    """Shared share (Jaccard) of two fingerprints' hashes, whatever their positions."""
    ha, hb = (f"array_distinct(transform({x}, v -> shiftrightunsigned(v, {POS_BITS})))" for x in (a, b))
    both = f"size(array_intersect({ha}, {hb}))"
    return F.expr(f"if(size({a}) = 0 and size({b}) = 0, 1D, {both} / cast(size({ha}) + size({hb}) - {both} as double))")


def _range_of(cuts: list[int]) -> Column:
    """How many cuts are at or below doc_id, found in two steps: among every n-th cut, then among the n that follow it."""
    n = max(1, int(len(cuts) ** 0.5))
    parts = [cuts[i : i + n] for i in range(0, len(cuts), n)]
    if not parts:
        return F.lit(0)
    longs = lambda xs: "array(" + ",".join(f"{x}L" if x != -(1 << 63) else "-9223372036854775807L" for x in xs) + ")"
    at = f"size(filter({longs([p[0] for p in parts])}, c -> c <= doc_id))"
    nested = "array(" + ",".join(map(longs, parts)) + ")"
    return F.expr(f"if({at} = 0, 0, ({at} - 1) * {n} + size(filter(element_at({nested}, greatest({at}, 1)), c -> c <= doc_id)))")


def with_following(df: DataFrame, cols: list[str]) -> DataFrame:
    """Adds the struct `_next` of cols of the row that follows by descending doc_id; the first row follows the last.

    Rows are dealt to ranges of doc_id, of RANGE_BYTES of text on average, and each range is ordered on its own (a sort that
    spills). Equal ids stay in one range, as do null ones; the order by text among them needs them together. A range's first rows also stand, marked, at
    the end of the range before it (the first range's at the end of the last), so each row's follower is in its range.
    """
    ids = df.select("doc_id")
    size = df.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = max(RANGES, 2 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(-(-size // RANGE_BYTES), MOST_RANGES))
    cuts = ids.agg(F.percentile_approx("doc_id", [i / ranges for i in range(1, ranges)], 100 * ranges).alias("q")).first().q or []
    place = F.coalesce(_range_of(sorted(set(cuts))), F.lit(-1))
    tops = {r._b: r.top for r in ids.select(place.alias("_b"), "doc_id").groupBy("_b").agg(F.max("doc_id").alias("top")).collect()}
    down = sorted(tops, reverse=True)
    before = {b: down[i - 1] for i, b in enumerate(down)}  # of the first: the last
    df = df.withColumn("_b", place)
    if tops:
        pairs = ",".join(f"{b},{before[b]}" for b in down)
        top_of = ",".join(f"{b},{'cast(null as bigint)' if tops[b] is None else f'{tops[b]}L'}" for b in down)
        is_top = F.expr(f"doc_id <=> element_at(map({top_of}), _b)")
        own = F.struct(F.col("_b").alias("b"), F.lit(False).alias("mark"))
        copy = F.struct(F.expr(f"element_at(map({pairs}), _b)").alias("b"), F.lit(True).alias("mark"))
        df = df.withColumn("_p", F.explode(F.when(is_top, F.array(own, copy)).otherwise(F.array(own))))
    else:
        df = df.withColumn("_p", F.struct(F.col("_b").alias("b"), F.lit(False).alias("mark")))
    order = Window.partitionBy("_p.b").orderBy("_p.mark", F.col("doc_id").desc_nulls_last(), F.col("text").asc_nulls_first())
    return df.withColumn("_next", F.lead(F.struct(*cols)).over(order)).where("not _p.mark").drop("_b", "_p")


def fingerprint(docs: DataFrame) -> DataFrame:
    """docs (all columns but a former `fingerprint`) with the text `fingerprint`."""
    keep = [c for c in docs.columns if c != "fingerprint"]
    df = with_fingerprint(docs.select(F.struct(*keep).alias("_row"), F.coalesce("text", F.lit("")).alias("_text")), "_text", "_fp")
    return df.select("_row.*", digest("_fp").alias("fingerprint"))


def fingerprint_edited(docs: DataFrame) -> DataFrame:
    """Each document's fingerprint and that of its edited text, whose last third is the start of the next document."""
    df = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    df = with_following(with_fingerprint(df, "text", "fp"), ["text", "fp"])
    third = "floor(length(text) / 3)"
    df = df.selectExpr("doc_id", "cast(length(text) as bigint) n_chars", "fp", "_next.fp next_fp", f"concat(left(text, cast(length(text) - {third} as int)), left(_next.text, cast({third} as int))) edited")
    df = df.selectExpr("*", "sha2(encode(edited, 'UTF-8'), 256) edited_sha256")
    df = with_fingerprint(df, "edited", "edited_fp")
    return df.select("doc_id", "n_chars", "edited_sha256", digest("fp").alias("fingerprint"), digest("edited_fp").alias("edited_fingerprint"), likeness("fp", "edited_fp").alias("near_edited"), likeness("fp", "next_fp").alias("near_next"))


_WORDS = "list_filter(regexp_split_to_array({0}, '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')"
#: The same as SQL.
SQL = f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
n AS (SELECT doc_id, text, coalesce(lead(text) OVER o, first_value(text) OVER (ORDER BY doc_id DESC NULLS LAST, text)) AS follows FROM d WINDOW o AS (ORDER BY doc_id DESC NULLS LAST, text)),
e AS (SELECT *, left(text, length(text) - length(text) // 3) || left(follows, length(text) // 3) AS edited FROM n),
t AS (SELECT DISTINCT text AS x FROM e UNION SELECT DISTINCT edited FROM e),
h AS (SELECT x, list_transform({_WORDS.format("x")}, lambda w: CAST('0x' || left(md5(w), 8) AS BIGINT)) AS h FROM t),
g AS (SELECT x, CASE WHEN len(h) = 0 THEN []::BIGINT[] WHEN len(h) < {K} THEN [list_reduce(list_prepend(0::BIGINT, h), lambda s, y: (s * {BASE} + y) % {MOD})]
  ELSE list_transform(range(1, len(h) - {K - 2}), lambda i: list_reduce(list_prepend(0::BIGINT, h[i : i + {K - 1}]), lambda s, y: (s * {BASE} + y) % {MOD})) END AS g FROM h),
p AS (SELECT x, list_transform(range(1, len(g) + 1), lambda i: (g[i] << {POS_BITS}) | ({POS_MASK} - (i - 1))) AS g FROM g),
f AS (SELECT x, list_sort(list_transform(list_distinct(list_transform(range(1, greatest(len(g) - {W - 2}, least(len(g), 1) + 1)), lambda i: list_min(g[i : i + {W - 1}]))), lambda v: {{'p': {POS_MASK} - (v & {POS_MASK}), 'h': v >> {POS_BITS}}})) AS f FROM p),
s AS (SELECT x, list_distinct(list_transform(f, lambda v: v.h)) AS hs, array_to_string(list_transform(f, lambda v: printf('%x:%x', v.p, v.h)), ' ') AS shown FROM f)
SELECT doc_id, length(text) AS n_chars, sha256(edited) AS edited_sha256, a.shown AS fingerprint, b.shown AS edited_fingerprint,
 CASE WHEN len(a.hs) = 0 AND len(b.hs) = 0 THEN 1.0::DOUBLE ELSE len(list_intersect(a.hs, b.hs)) / CAST(len(a.hs) + len(b.hs) - len(list_intersect(a.hs, b.hs)) AS DOUBLE) END AS near_edited,
 CASE WHEN len(a.hs) = 0 AND len(c.hs) = 0 THEN 1.0::DOUBLE ELSE len(list_intersect(a.hs, c.hs)) / CAST(len(a.hs) + len(c.hs) - len(list_intersect(a.hs, c.hs)) AS DOUBLE) END AS near_next
FROM e JOIN s a ON a.x = text JOIN s b ON b.x = edited JOIN s c ON c.x = follows"""
