"""URL filters with a Bloom filter cascade. DataFrame operations only.

Two lists judge a url: rules (host, path, verdict), of which the longest that fits wins, and blocked hosts, for urls that
no rule fits. Both become membership questions over keys that the urls themselves offer: every host suffix with every path
prefix that is as long as that of some rule, and every host suffix. The set of all keys that
the corpus offers is known, so a Bloom filter cascade answers exactly: level 0 holds the listed keys; level 1 holds the keys
of the universe that level 0 accepts though they aren't listed; level 2 holds the listed keys that level 1 accepts, and so
on until no false answer is left. A key's answer is the parity of the first level that refuses it.

A level of up to ``BROADCAST_KEYS`` keys is one array of longs in a single row, made by an aggregation and read as a scalar
subquery. A larger level, whether of listed keys or of false positives, is a table of blocks of bits that the keys are
equi-joined with by block number. The answers are exact for any number of either. While all levels are small, no url is joined
to anything; otherwise the distinct keys are asked once and their answers joined back to the distinct urls.

A url without ``://`` and a null url have an empty host and path, no rule and the verdict allow. Equal urls get equal answers;
ties between rules can't arise, as two rules of equal length that fit one url are equal.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import stash

BROADCAST_KEYS = 200_000
_BITS_PER_KEY, _HASHES, _MAX_LEVELS = 10, 4, 24
_BLOCK_WORDS = 64


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _spots(key: Column, level: int, size: int) -> list[Column]:
    base = F.xxhash64(F.lit(level), key)
    return [F.pmod(F.xxhash64(base, F.lit(k)), F.lit(size)) for k in range(_HASHES)]


def _bits(spots: DataFrame, words: int, *by: str) -> DataFrame:
    """One array of ``words`` longs per ``by``, with the bits at ``spot`` set."""
    each = spots.groupBy(*by, F.expr("spot div 64").alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(spot % 64 as int))")).alias("bits"))
    whole = each.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("at", "bits"))).alias("by"))
    return whole.select(*by, F.transform(F.sequence(F.lit(0), F.lit(words - 1)), lambda i: F.coalesce(F.element_at("by", i.cast("long")), F.lit(0).cast("long"))).alias("bits"))


class Cascade:
    """Levels of a Bloom filter cascade: one-row tables of bit words, or tables of bit blocks for large levels."""

    def __init__(self, listed: DataFrame, universe: DataFrame) -> None:
        """``listed(key)`` are the members, ``universe(key)`` every key that will be asked for; both distinct."""
        self.levels: list[tuple[DataFrame, int]] = []
        self.blocks: dict[int, int] = {}  # the number of blocks of each level that has to be joined
        inside, outside = stash(listed.intersect(universe), "listed"), universe.subtract(listed)
        for level in range(_MAX_LEVELS):
            n = inside.count()
            if n == 0:
                return
            self._add(inside, n)
            wrong = stash(self._ask(outside, level).where(f"_ok{level}").select("key"), "accepted")
            inside, outside = wrong, inside
        raise ValueError("the cascade doesn't end; hashes collide")

    def _add(self, keys: DataFrame, n: int) -> None:
        level = len(self.levels)
        if n > BROADCAST_KEYS:
            self.blocks[level], size = -(-n * _BITS_PER_KEY // (64 * _BLOCK_WORDS)), 64 * _BLOCK_WORDS
            spots = keys.select(_block(F.col("key"), level, self.blocks[level]).alias("block"), F.explode(F.array(*_spots(F.col("key"), level, size))).alias("spot"))
            self.levels.append((stash(_bits(spots, _BLOCK_WORDS, "block"), "blocks"), size))
            return
        size = 64 * max(1, -(-n * _BITS_PER_KEY // 64))
        # at most BROADCAST_KEYS * 10 / 64 words
        full = _bits(keys.select(F.explode(F.array(*_spots(F.col("key"), level, size))).alias("spot")), size // 64)
        self.levels.append((stash(full, "bits"), size))

    def _ask(self, rows: DataFrame, level: int) -> DataFrame:
        """``rows(key, ...)`` with ``_ok``: whether the level accepts the key."""
        words, size = self.levels[level]
        if level not in self.blocks:
            rows = rows.withColumn(f"_bits{level}", words.scalar())
        else:
            blocks = words.select(F.col("block").alias("_block"), F.col("bits").alias(f"_bits{level}"))
            rows = rows.withColumn("_block", _block(F.col("key"), level, self.blocks[level])).join(blocks, "_block", "left").drop("_block")
        return rows.withColumn(f"_ok{level}", F.coalesce(_accepts(F.col("key"), level, size), F.lit(False))).drop(f"_bits{level}")

    def members(self, keys: DataFrame) -> DataFrame:
        """The listed ones of ``keys(key)``, which are distinct and of the universe; for any size of the levels."""
        for level in range(len(self.levels)):
            keys = self._ask(keys, level)
        return keys.where(self._parity(lambda level: F.col(f"_ok{level}"))).select("key")

    def _parity(self, accepts) -> Column:
        answer: Column = F.lit(len(self.levels) % 2 == 1)
        for level in reversed(range(len(self.levels))):
            answer = F.when(accepts(level), answer).otherwise(F.lit(level % 2 == 1))
        return answer

    def attach(self, rows: DataFrame) -> DataFrame:
        """``rows`` with the levels' bits as columns, which ``contains`` reads; drop them by selecting others. For small levels only."""
        if not self.levels:
            return rows
        return rows.withColumns({f"_bits{k}": words.scalar() for k, (words, _) in enumerate(self.levels)})

    def contains(self, key: Column) -> Column:
        """Whether ``key`` of the universe is listed, over rows that ``attach`` has made."""
        return self._parity(lambda level: _accepts(key, level, self.levels[level][1]))


def _block(key: Column, level: int, blocks: int) -> Column:
    return F.pmod(F.xxhash64(F.lit("block"), F.lit(level), key), F.lit(blocks))


def _accepts(key: Column, level: int, size: int) -> Column:
    hit, words = F.lit(True), F.col(f"_bits{level}")
    for spot in _spots(key, level, size):
        word = F.get(words, (spot / 64).cast("int"))
        hit = hit & (F.call_function("shiftrightunsigned", word, (spot % 64).cast("int")).bitwiseAND(F.lit(1)) == 1)
    return hit


def _suffixes(host: Column) -> Column:
    """The host and all its parent domains, longest first; none for an empty host."""
    labels = F.split(host, r"\.", -1)
    return F.when(host != "", F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))).otherwise(F.array().cast("array<string>"))


def hosts_with_word(pages: DataFrame, words: list[str]) -> DataFrame:
    """A block list made from the pages' own hosts: those with a label that begins with one of ``words`` and a hyphen."""
    hosts = pages.select(host_of(F.col("url").cast("string")).alias("host")).distinct()
    heads = F.array(*[F.lit(f"{w}-") for w in words])
    return hosts.where(F.exists(F.split("host", r"\."), lambda x: F.exists(heads, lambda h: x.startswith(h))))


def decide(pages: DataFrame, rules: list[tuple[str, str, str]], blocked: DataFrame) -> DataFrame:
    """Columns ``page_id, host, path, rule, verdict`` of ``pages(page_id, url, ...)``.

    ``rules`` are (host, path prefix, allow or block); ``blocked(host)`` lists hosts that are blocked with all their
    subdomains where no rule fits.
    """
    spark = pages.sparkSession
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url")).withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    depths = sorted({len(p) for _, p, _ in rules})
    prefixes = F.filter(F.array(*[F.when(F.length("path") >= n, F.substring("path", 1, n)) for n in depths]), lambda p: p.isNotNull())
    offered = F.flatten(F.transform(_suffixes(F.col("host")), lambda h: F.transform(prefixes, lambda p: F.struct((F.length(h) + F.length(p)).alias("n"), F.concat(h, p).alias("rule")))))
    of_rule = rows.select(F.explode(offered).alias("k")).select(F.concat(F.lit("rule "), "k.rule").alias("key"))
    of_host = rows.select(F.explode(_suffixes(F.col("host"))).alias("h")).select(F.concat(F.lit("host "), "h").alias("key"))
    fixed = spark.range(1).select(F.explode(F.array(*[F.lit(f"rule {h}{p}") for h, p, _ in rules])).alias("key"))
    listed = fixed.union(blocked.select(F.concat(F.lit("host "), "host").alias("key"))).distinct()
    universe = stash(of_rule.union(of_host).distinct(), "urlkeys")
    known = Cascade(listed, universe)
    verdicts = F.create_map(*[F.lit(x) for h, p, v in rules for x in (h + p, v)])
    verdict = F.coalesce(F.element_at(verdicts, F.col("rule")), F.when(F.col("refused"), "block").otherwise("allow")).alias("verdict")
    if known.blocks:
        hits = stash(known.members(universe), "members").withColumn("hit", F.lit(True))
        urls = rows.select("host", "path").distinct()
        asked = F.concat(
            F.transform(offered, lambda k: F.struct(F.concat(F.lit("rule "), k["rule"]).alias("key"), k.alias("k"))),
            F.transform(_suffixes(F.col("host")), lambda h: F.struct(F.concat(F.lit("host "), h).alias("key"), F.lit(None).cast("struct<n:int,rule:string>").alias("k"))),
        )
        found = urls.select("host", "path", F.explode(asked).alias("a")).select("host", "path", "a.*").join(hits, "key")
        told = found.groupBy(F.col("host").alias("_host"), F.col("path").alias("_path")).agg(F.max("k")["rule"].alias("rule"), F.max(F.col("k").isNull()).alias("refused"))
        rows = rows.join(told, (rows.host == told._host) & (rows.path == told._path), "left")
        return rows.select("page_id", "host", "path", "rule", verdict)
    best = F.array_max(F.filter(offered, lambda k: known.contains(F.concat(F.lit("rule "), k["rule"]))))["rule"]
    refused = F.exists(_suffixes(F.col("host")), lambda h: known.contains(F.concat(F.lit("host "), h)))
    rows = known.attach(rows).withColumn("rule", best).withColumn("refused", refused)
    return rows.select("page_id", "host", "path", "rule", verdict)
