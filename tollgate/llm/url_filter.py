"""URL verdicts by rules on canonical (host, path) prefixes.

Every listed rule goes into a blocked Bloom filter: a key picks one block of
512 bits and sets ``BITS`` bits in it, so a test reads one block. The filter
is built and probed as a table of blocks; the probe joins on the block number.
A URL offers the keys (host suffix at a label, path prefix of a listed
length); keys that pass the filter are possible hits and go on to an exact
hash join with the list, which removes false positives. Of the rules that
fit, the longest wins.

The table of blocks is broadcast only while its size, known from the number
of rules, is at most ``MAX_BROADCAST_MB``; beyond that both joins shuffle.
Distinct URLs are judged once, so a URL repeated in a third of all rows is
one row before the keys are made.

Defined results: a null URL or one without ``://`` has an empty host and
path, no rule, and the default verdict; an empty path fits only rules with an
empty path; of fitting rules of one length, and of a rule listed twice, block goes
before allow and then the later in text order; null ids and repeated rows are
judged like any other row; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: (verdict, host, path). Fixed values of the query.
RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]
DEFAULT = "allow"
BITS = 6
BITS_PER_KEY = 16
BLOCK_BITS = 512
MAX_BROADCAST_MB = 64
SEEDS = (11, 23)


def canonical(url: Column) -> tuple[Column, Column]:
    """Host and path of a URL."""
    url = F.coalesce(url.cast("string"), F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    host = F.regexp_extract(rest, "(?s)^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), "(?s)^[^?#]*", 0)
    low = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return low, path


def rules_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    return spark.createDataFrame(rules, "rule_verdict string, rule_host string, rule_path string")


def _key() -> Column:
    return F.concat(F.col("host_part"), F.col("path_part"))


def _spots(blocks: int) -> tuple[Column, list[Column]]:
    """Block of a key, and the places of its bits in the block."""
    a, b = (F.xxhash64(F.lit(seed), _key()) for seed in SEEDS)
    start, step = F.pmod(b, F.lit(BLOCK_BITS)), F.pmod(F.shiftrightunsigned(b, 32), F.lit(BLOCK_BITS // 2)) * 2 + 1
    places = [F.pmod(start + F.lit(i) * step, F.lit(BLOCK_BITS)).cast("int") for i in range(BITS)]
    return F.pmod(a, F.lit(blocks)), places


def bloom_blocks(keys: DataFrame, blocks: int) -> DataFrame:
    """``block, words`` (eight 64-bit words) of the blocked filter over
    ``host_part, path_part``."""
    block, places = _spots(blocks)
    one = F.call_function("shiftleft", F.expr("1L"), F.pmod("place", F.lit(64)))
    bits = keys.select(block.alias("block"), F.explode(F.array(*places)).alias("place"))
    word = bits.select("block", F.floor(F.col("place") / 64).alias("k"), one.alias("bit"))
    made = word.groupBy("block").agg(*[F.bit_or(F.when(F.col("k") == k, F.col("bit"))).alias(f"w{k}") for k in range(BLOCK_BITS // 64)])
    return made.select("block", F.array(*[F.coalesce(f"w{k}", F.lit(0).cast("long")) for k in range(BLOCK_BITS // 64)]).alias("words"))


def probe(candidates: DataFrame, filter_blocks: DataFrame, blocks: int, small: bool) -> DataFrame:
    """The candidates whose bits are all set in their block."""
    block, places = _spots(blocks)
    asked = candidates.withColumns({"block": block, "places": F.array(*places)})
    hit = asked.join(F.broadcast(filter_blocks) if small else filter_blocks, "block")
    for i in range(BITS):
        place = F.col("places")[i]
        word = F.element_at("words", F.floor(place / 64).cast("int") + 1)
        hit = hit.filter(F.call_function("shiftrightunsigned", word, F.pmod(place, F.lit(64))).bitwiseAND(F.expr("1L")) == 1)
    return hit.select(*candidates.columns)


def judge(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url",
          default: str = DEFAULT) -> DataFrame:
    """``id_col, host, path, rule, verdict`` for every row of ``pages``."""
    count, lengths = rules.agg(F.count(F.lit(1)), F.collect_set(F.length("rule_path"))).first()
    blocks = max(1, -(-count * BITS_PER_KEY // BLOCK_BITS))
    small = blocks * BLOCK_BITS / 8 <= MAX_BROADCAST_MB << 20
    listed = rules.select(F.col("rule_host").alias("host_part"), F.col("rule_path").alias("path_part"), "rule_verdict")
    host, path = canonical(F.col(url_col))
    rows = pages.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path"))
    sites = rows.select("host", "path").distinct()
    labels = F.split("host", "\\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    prefixes = F.transform(F.filter(F.array(*[F.lit(n) for n in sorted(lengths)]).cast("array<int>"),
                                    lambda n: n <= F.length("path")), lambda n: F.substr("path", F.lit(1), n))
    candidates = sites.select("host", "path", F.explode(suffixes).alias("host_part"), F.lit(0).alias("_")).select(
        "host", "path", "host_part", F.explode(prefixes).alias("path_part"))
    possible = probe(candidates, bloom_blocks(listed, blocks), blocks, small)
    exact = possible.join(listed, ["host_part", "path_part"])
    best = F.max(F.struct(F.length(_key()).alias("n"), (F.col("rule_verdict") == "block").alias("blocks"),
                          _key().alias("rule"), F.col("rule_verdict").alias("verdict")))
    judged = exact.groupBy("host", "path").agg(best.alias("b")).select("host", "path", "b.rule", "b.verdict")
    return rows.join(judged, ["host", "path"], "left").select(
        F.col("id").alias(id_col), "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))


def url_query(pages: DataFrame) -> DataFrame:
    return judge(pages, rules_table(pages.sparkSession, RULES))


URL_SQL = r"""
WITH r AS (SELECT * FROM (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'),
                                 ('allow', 'com', '/fr/'), ('block', 'com', '/de/')) v(verdict, rh, rp)),
p AS (SELECT page_id, CASE WHEN strpos(coalesce(url, ''), '://') > 0
                           THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
q AS (SELECT page_id, regexp_extract(rest, '^[^/?#]*') AS h, rest FROM p),
s AS (SELECT page_id, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(substr(rest, length(h) + 1), '^[^?#]*') AS path FROM q),
f AS (SELECT s.*, (SELECT {rule: rh || rp, verdict: r.verdict} FROM r
                   WHERE (s.host = rh OR ends_with(s.host, '.' || rh)) AND starts_with(s.path, rp)
                   ORDER BY length(rh || rp) DESC LIMIT 1) AS b FROM s)
SELECT page_id, host, path, b.rule AS rule, coalesce(b.verdict, 'allow') AS verdict FROM f
"""
