"""Operator 1, URL filters: a blocked Bloom filter of listed canonical URLs, then an exact hash join.

Both lists hold canonical prefixes, `host` + `path`: an entry fits its host and every subdomain when the url's path
starts with the entry's path. `rules` carry their own verdict; `listed` entries block where no rule fits.

The filter holds the entries' hosts and the entries. A url tries the suffixes of its host first, and only for those that may be
listed the prefixes of its path, in the lengths that occur with that many labels. Lengths are data, in one small row beside the
filter, so the plan does not grow with the lists. The filter is an array of blocks that all tasks have, as long as it is small
(BROADCAST_BYTES); it is put together from pieces, each built in its own task. Beyond, it is a table joined by block number.
Rows without a possible hit end there, in no shuffle. The others' different urls go on to the exact join, so false positives of
the filter never show, and the winners are joined back; a url that very many rows share is counted map-side, and its rows are
joined by a broadcast, or as a skewed key.

Cases: null url or one without `://` has empty host and path and fits nothing (verdict allow); repeated rows each get
their row; an empty table gives an empty result; other columns of the input are kept, whatever their names, but for former
host, path, rule and verdict, which are replaced; of equal keys with two verdicts, block wins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, lower_ascii, small, stored

BITS_PER_KEY = 16
LANES = 4  # of 64 bits: a block has 256
PIECE = 4096  # blocks that one task packs


def host_path(url: Column) -> tuple[Column, Column]:
    """Canonical host and path; both empty for null or where there is no `://`."""
    host = lower_ascii(F.regexp_extract(url, r"://([^/?#]*)", 1))
    path = F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def _hashed(df: DataFrame, blocks: int) -> DataFrame:
    """Adds the block of `key` and the bits it sets in each lane."""
    out = df.withColumn("block", F.pmod(F.xxhash64("key"), F.lit(blocks))).withColumn("bits", F.xxhash64("key", F.lit(1)))
    return out.select(
        *df.columns,
        "block",
        *(
            F.expr(
                _mask(k, "bits")
            ).alias(f"mask{k}")
            for k in range(LANES)
        ),
    )


def bloom_blocks(keys: DataFrame, blocks: int) -> DataFrame:
    """One row for each block that is not empty, its 256 bits in four longs; built with map-side combining."""
    return _hashed(keys.select("key"), blocks).groupBy("block").agg(*(F.bit_or(f"mask{k}").alias(f"word{k}") for k in range(LANES)))


def filter_urls(pages: DataFrame, rules: DataFrame, listed: DataFrame, url: str = "url") -> DataFrame:
    """pages with `host, path, rule, verdict` added.

    rules: (host, path, verdict); listed: (host, path). rule is the winning rule's host + path or null.
    """
    keys = (
        rules.select("host", "path", F.lit(True).alias("is_rule"), F.col("verdict"))
        .unionByName(listed.select("host", "path", F.lit(False).alias("is_rule"), F.lit("block").alias("verdict")))
        .select(F.concat("host", F.lit("\n"), "path").alias("key"), F.size(F.split("host", "[.]")).alias("labels"), F.length("path").alias("chars"), F.concat("host", "path").alias("entry"), "is_rule", "verdict")
    )
    keys = stored(keys, "url-keys")
    n_keys = keys.count()
    blocks = max(1, -(-2 * n_keys * BITS_PER_KEY // 256))

    row = pages.select(F.struct(*pages.columns).alias("row"), F.col(url).alias("url"))
    row = row.select("row", F.when(F.instr("url", "://") > 0, F.col("url")).alias("url"))
    marked = _possible(row, keys, blocks)
    hits = marked.where("size(possible) > 0")
    tried = hits.select("url", "possible").distinct().select("url", F.explode("possible").alias("key"))
    best = (
        tried.join(small(keys, n_keys, 400), "key")
        .groupBy("url")
        .agg(F.max(F.struct("is_rule", F.length("entry").alias("n"), "entry", "verdict")).alias("best"))
    )
    best = stored(best, "url-hits")
    n_best = best.count()
    if n_best * 400 <= BROADCAST_BYTES:
        won = F.broadcast(best.withColumnRenamed("url", "hit"))
        every = marked.join(won, F.when(F.size("possible") > 0, F.col("url")) == F.col("hit"), "left").select("row", "best")
    else:  # rows without a hit stay out of the shuffle
        judged = hits.select("row", "url").join(best, "url", "left")
        every = judged.select("row", "best").unionByName(marked.where("size(possible) = 0").select("row", F.lit(None).cast(best.schema["best"].dataType).alias("best")))
    host, path = host_path(F.col(f"row.`{url}`"))
    kept = [F.col(f"row.`{c}`").alias(c) for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    return every.select(
        *kept,
        host.alias("host"),
        path.alias("path"),
        F.when(F.col("best.is_rule"), F.col("best.entry")).alias("rule"),
        F.coalesce(F.col("best.verdict"), F.lit("allow")).alias("verdict"),
    )


def _lengths(keys: DataFrame) -> DataFrame:
    """One row: `lengths`, the path lengths of the entries by their number of labels (at most 127 in a host name)."""
    each = keys.groupBy("labels").agg(F.sort_array(F.collect_set("chars")).alias("chars"))
    none = F.expr("cast(map() as map<int, array<int>>)")
    return each.agg(F.coalesce(F.map_from_entries(F.collect_list(F.struct("labels", "chars"))), none).alias("lengths"))


def _packed(filled: DataFrame, blocks: int) -> DataFrame:
    """One row: `words`, the blocks' longs in pieces of PIECE blocks. A piece is sorted by itself; the last step gathers few pieces."""
    words = [f"word{k}" for k in range(LANES)]
    every = filled.sparkSession.range(blocks).withColumnRenamed("id", "block").join(filled, "block", "left").na.fill(0, words)
    pieces = every.groupBy(F.floor(F.col("block") / PIECE).alias("piece")).agg(F.sort_array(F.collect_list(F.struct("block", F.array(*words).alias("w")))).alias("l"))
    pieces = pieces.select("piece", F.flatten(F.transform("l", lambda x: x["w"])).alias("w"))
    return pieces.agg(F.sort_array(F.collect_list(F.struct("piece", "w"))).alias("l")).select(F.transform("l", lambda x: x["w"]).alias("words"))


def _possible(row: DataFrame, keys: DataFrame, blocks: int) -> DataFrame:
    """row(row, url) with `possible`, the keys of its url that the filter does not rule out (none for a null url)."""
    host, path = host_path(F.col("url"))
    x = row.withColumns({"h": host, "p": path}).withColumn("labels", F.size(F.split("h", "[.]")))
    lengths = _lengths(keys)
    hosts = "transform(filter(sequence(1, labels), n -> url is not null and map_contains_key(lengths, n)), n -> struct(n, substring_index(h, '.', -n) as k))"
    prefixes = "flatten(transform(hosts, s -> transform(filter(element_at(lengths, s.n), m -> m <= length(p)), m -> concat(s.k, '\n', substring(p, 1, m)))))"
    held = keys.select("key").unionByName(keys.select(F.substring_index("key", "\n", 1).alias("key"))).distinct()
    filled = bloom_blocks(held, blocks)
    if blocks * LANES * 8 <= BROADCAST_BYTES:

        def inside(key: str) -> str:
            """Are all bits of the key set in its block?"""
            at = f"cast(pmod(xxhash64({key}), {blocks}L) as int)"
            masks = [_mask(j, f"xxhash64({key}, 1)") for j in range(LANES)]
            return " and ".join(f"words[{at} div {PIECE}][{at} % {PIECE} * {LANES} + {j}] & ({m}) = ({m})" for j, m in enumerate(masks))

        own = x.join(F.broadcast(_packed(filled, blocks).join(lengths)))
        own = own.withColumn("hosts", F.expr(f"filter({hosts}, s -> {inside('s.k')})"))
        return own.withColumn("keys", F.expr(prefixes)).select("row", "url", F.expr(f"filter(keys, k -> {inside('k')})").alias("possible"))
    x = x.join(F.broadcast(lengths)).withColumn("hosts", F.expr(hosts)).withColumn("keys", F.expr(prefixes))
    urls = x.where("size(keys) > 0").select("url", "keys").distinct().select("url", F.explode("keys").alias("key"))
    inside = F.lit(True)
    for k in range(LANES):
        inside = inside & (F.col(f"word{k}").bitwiseAND(F.col(f"mask{k}")) == F.col(f"mask{k}"))
    passed = _hashed(urls, blocks).join(filled, "block").where(inside).groupBy("url").agg(F.collect_set("key").alias("possible"))
    return x.select("row", "url").join(passed, "url", "left").withColumn("possible", F.coalesce("possible", F.expr("cast(array() as array<string>)")))


def _mask(lane: int, bits: str) -> str:
    """The bits that a key's second hash sets in a lane of its block, as SQL."""
    bit = lambda by: f"shiftleft(1L, cast(shiftrightunsigned({bits}, {by}) & 63 as int))"
    return f"{bit(12 * lane)} | {bit(12 * lane + 6)}"


def sql(rules: tuple[tuple[str, str, str], ...], listed: tuple[str, ...]) -> str:
    """The same over `pages` as SQL, every page against every entry."""
    rows = ", ".join([f"('{h}', '{p}', '{v}', true)" for h, p, v in rules] + [f"('{h}', '', 'block', false)" for h in listed])
    up = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return f"""WITH e AS (SELECT * FROM (VALUES {rows}) v(h, p, verdict, is_rule)),
u AS (SELECT page_id, coalesce(translate(regexp_extract(url, '://([^/?#]*)', 1), '{up}', '{up.lower()}'), '') AS host, coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path, row_number() OVER () AS n FROM pages),
m AS (SELECT n, arg_max({{'entry': h || p, 'verdict': e.verdict, 'is_rule': is_rule}}, (is_rule::INT, length(h || p), h || p, e.verdict)) AS b FROM u JOIN e ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY 1)
SELECT page_id, host, path, CASE WHEN b.is_rule THEN b.entry END AS rule, coalesce(b.verdict, 'allow') AS verdict FROM u LEFT JOIN m USING (n)"""
