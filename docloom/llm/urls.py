"""URL filters: rules on host and path, and gradient-boosted trees for the URLs that no rule fits. DataFrame and SQL functions only.

URLs that a rule judges are the labelled ones. Trees are grown on lexical features of at most ``SAMPLE`` of them, about: lengths,
depths, digit ratios, entropies, parameter counts, and statistics of suffixes (of the host's last label, its last two, the whole host,
the path's ending, and of the first directory): the share of blocked URLs among all labelled ones of one half of the table, the trees
being grown on the other half. Suffixes are hashed to ``BUCKETS`` buckets of each kind, so these statistics have a bounded size
whatever the number of hosts, and are broadcast. Histograms are sums over the sample by Spark; the driver sees those sums alone.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import lower_ascii, stash, table

#: Bound of the labelled URLs, distinct ones, that trees are grown on, about.
SAMPLE = 20_000
TREES, DEPTH, RATE, BINS, LEAST, L2 = 16, 3, 0.3, 16, 5, 1.0
#: Buckets of each kind of suffix, and the weight of the overall share in a bucket's.
BUCKETS, PRIOR = 1 << 16, 10.0
#: Gradients are summed as whole numbers of this part, so that sums don't depend on the order of rows.
UNIT = 1 << 24
LEXICAL = ["length", "host_length", "path_length", "query_length", "depth", "labels", "host_hyphens", "digits", "host_digits", "path_digits", "entropy", "host_entropy", "parameters"]
SUFFIXES = ["last_label", "last_two_labels", "whole_host", "path_ending", "first_directory"]
FEATURES = LEXICAL + SUFFIXES


@dataclass(frozen=True)
class Rule:
    """Fits ``host`` and its subdomains where the path starts with ``path``."""

    allow: bool
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


RULES = (Rule(True, "org", "/"), Rule(False, "example.org", "/es/"), Rule(False, "example.org", "/en/1"), Rule(True, "com", "/fr/"), Rule(False, "com", "/de/"))
_AUTHORITY = r"(?s)\A.*?://([^/?#]*)([^?#]*)(?:\?([^#]*))?"


def parts(pages: DataFrame) -> DataFrame:
    """``page_id, url, host, path, _query``; a null url counts as empty, and one without ``://`` has none of the three."""
    url = F.coalesce("url", F.lit(""))
    part = lambda k: F.regexp_extract(url, _AUTHORITY, k)
    return pages.select("page_id", url.alias("url"), lower_ascii(part(1)).alias("host"), part(2).alias("path"), part(3).alias("_query"))


def rule_of(rules: Sequence[Rule]) -> Column:
    """The longest rule that fits ``host`` and ``path``, as a struct of its name and whether it allows; of equally long ones the first that
    blocks, then the first by name. Rules are a list in the plan: some hundreds, not a table."""
    fits = lambda r: ((F.col("host") == r.host) | F.col("host").endswith("." + r.host)) & F.col("path").startswith(r.path)
    ordered = sorted(rules, key=lambda r: (-len(r.name), r.allow, r.name))
    found = [F.when(fits(r), F.struct(F.lit(r.name).alias("name"), F.lit(r.allow).alias("allow"))) for r in ordered]
    return F.coalesce(*found) if found else F.lit(None).cast("struct<name:string,allow:boolean>")


def entropy(text: Column) -> Column:
    """Bits a character, from the runs of the sorted characters; 0 for an empty text."""
    bits = lambda n: F.when(n > 0, n * F.log2(n)).otherwise(F.lit(0.0))
    start = F.struct(F.lit("").alias("c"), F.lit(0.0).alias("n"), F.lit(0.0).alias("s"))
    again = lambda a: F.struct(a["c"].alias("c"), (a["n"] + 1).alias("n"), a["s"].alias("s"))
    other = lambda a, c: F.struct(c.alias("c"), F.lit(1.0).alias("n"), (a["s"] + bits(a["n"])).alias("s"))
    total = F.aggregate(F.array_sort(F.split(text, "")), start, lambda a, c: F.when(c == "", a).when(a["c"] == c, again(a)).otherwise(other(a, c)), lambda a: a["s"] + bits(a["n"]))
    n = F.char_length(text)
    return F.when(n == 0, 0.0).otherwise(F.log2(n) - total / n)


def _share(of: Column, pattern: str) -> Column:
    n = F.char_length(of)
    return F.when(n == 0, 0.0).otherwise(F.regexp_count(of, F.lit(pattern)) / n)


def lexical() -> dict[str, Column]:
    """The features of a URL alone."""
    url, host, path, query = (F.col(c) for c in ("url", "host", "path", "_query"))
    own = [
        F.char_length(url), F.char_length(host), F.char_length(path), F.char_length(query), F.regexp_count(path, F.lit("/[^/]")), F.regexp_count(host, F.lit("[^.]+")), F.regexp_count(host, F.lit("-")),
        _share(url, "[0-9]"), _share(host, "[0-9]"), _share(path, "[0-9]"), entropy(url), entropy(host), F.regexp_count(query, F.lit("[^&]+")),
    ]
    return dict(zip(LEXICAL, own, strict=True))


def suffixes() -> dict[str, Column]:
    host, path = F.col("host"), F.col("path")
    own = [F.substring_index(host, ".", -1), F.substring_index(host, ".", -2), host, F.regexp_extract(path, r"(\.[^./]*)\z", 1), F.regexp_extract(path, r"\A/([^/]*)/", 1)]
    return dict(zip(SUFFIXES, own, strict=True))


def _bucket(kind: int, suffix: Column) -> Column:
    return F.pmod(F.xxhash64(F.lit(kind), suffix), F.lit(BUCKETS)).cast("int")


def _half(url: Column) -> Column:
    return F.pmod(F.xxhash64(url, F.lit("half")), F.lit(2))


def suffix_statistics(labelled: DataFrame) -> DataFrame:
    """``kind, bucket, blocked`` of all of ``labelled(url, host, path, block)`` that lies in the first half: at most ``BUCKETS`` rows a kind.
    ``blocked``: the share of blocked URLs, drawn to the share of all of them where there are few."""
    keys = F.array(*[F.struct(F.lit(k).alias("kind"), _bucket(k, s).alias("bucket")) for k, s in enumerate(suffixes().values())])
    rows = labelled.where(_half(F.col("url")) == 0).select(F.explode(keys).alias("k"), F.col("block").cast("long").alias("block"))
    sums = rows.groupBy("k.kind", "k.bucket").agg(F.count("*").alias("n"), F.sum("block").alias("b"))
    every = sums.where("kind = 0").agg((F.sum("b") / F.sum("n")).alias("_all"))  # one row
    return sums.crossJoin(F.broadcast(every)).select("kind", "bucket", ((F.col("b") + PRIOR * F.col("_all")) / (F.col("n") + PRIOR)).alias("blocked"))


def with_features(rows: DataFrame, statistics: DataFrame, prior: float, asked: Column) -> DataFrame:
    """``rows`` and their ``FEATURES``, where ``asked``; null elsewhere."""
    rows = rows.withColumns({k: F.when(asked, c.cast("double")) for k, c in lexical().items()} | {f"_b{k}": F.when(asked, _bucket(k, s)) for k, s in enumerate(suffixes().values())})
    for k, name in enumerate(suffixes()):
        # At most BUCKETS rows of twelve bytes.
        own = statistics.where(F.col("kind") == k).select(F.col("bucket").alias("_own"), F.col("blocked").alias("_share"))
        rows = rows.join(F.broadcast(own), F.col(f"_b{k}") == F.col("_own"), "left")
        rows = rows.withColumn(name, F.when(asked, F.coalesce("_share", F.lit(prior)))).drop("_own", "_share", f"_b{k}")
    return rows


@dataclass
class Trees:
    """``splits``: for each tree its (feature, cut) in heap order, None where a node isn't cut; ``values``: its leaves."""

    base: float = 0.0
    splits: list[list[tuple[int, float] | None]] = field(default_factory=list)
    values: list[list[float]] = field(default_factory=list)

    def total(self) -> Column:
        """The sum of all trees as an expression over the columns ``FEATURES``."""
        out = F.lit(self.base)
        for splits, values in zip(self.splits, self.values):
            out = out + _walk(splits, [F.lit(float(v)) for v in values])
        return out

    def score(self) -> Column:
        """The probability that a URL is to be blocked."""
        return 1 / (1 + F.exp(-self.total()))


def _walk(splits: list[tuple[int, float] | None], ends: list[Column], node: int = 0) -> Column:
    """Nested comparisons from a node down to the ends below it; a node that isn't cut goes left."""
    if node >= len(splits):
        return ends[node - len(splits)]
    left = _walk(splits, ends, 2 * node + 1)
    if splits[node] is None:
        return left
    j, cut = splits[node]
    return F.when(F.col(FEATURES[j]) > cut, _walk(splits, ends, 2 * node + 2)).otherwise(left)


def grow(sample: DataFrame, trees: int = TREES, depth: int = DEPTH) -> Trees:
    """Boosted trees by logistic loss from ``sample(block, *FEATURES)``: for each level one sum of gradients by node, feature and bin."""
    seen = sample.agg(F.count("*").alias("n"), F.sum(F.col("block").cast("long")).alias("b")).first()
    n, b = seen["n"], seen["b"] or 0
    model = Trees(math.log((b + 0.5) / (n - b + 0.5)))
    if b in (0, n):
        return model
    shares = [i / BINS for i in range(1, BINS)]
    cuts = sample.agg(*[F.percentile_approx(c, shares, 10_000).alias(c) for c in FEATURES]).first()
    edges = [sorted(set(cuts[c])) for c in FEATURES]
    # A value's bin is the number of cuts below it.
    below = lambda c, own: sum((F.when(F.col(c) > e, 1).otherwise(0) for e in own), F.lit(0))
    bins = F.array(*[below(c, own) for c, own in zip(FEATURES, edges)])
    coded = stash(sample.withColumn("_bins", bins), "binned")
    for _ in range(trees):
        p = model.score()
        rows = coded.withColumn("_p", p).withColumns({"_g": F.round((F.col("_p") - F.col("block").cast("int")) * UNIT).cast("long"), "_h": F.round(F.col("_p") * (1 - F.col("_p")) * UNIT).cast("long")})
        splits: list[tuple[int, float] | None] = []
        values = [0.0]
        for level in range(depth):
            width = 1 << level
            node = _walk(splits, [F.lit(i) for i in range(width)]) if splits else F.lit(0)
            sums = rows.select(node.alias("node"), "_g", "_h", F.posexplode("_bins").alias("j", "bin")).groupBy("node", "j", "bin").agg(F.sum("_g").alias("g"), F.sum("_h").alias("h"), F.count("*").alias("n"))
            table_: dict[tuple[int, int], dict[int, tuple[float, float, int]]] = {}
            for r in sums.collect():  # nodes x features x bins
                table_.setdefault((r["node"], r["j"]), {})[r["bin"]] = (r["g"] / UNIT, r["h"] / UNIT, r["n"])
            found = [_best(i, table_, edges) for i in range(width)]
            splits += [s for s, *_ in found]
            values = [v for _, *own in found for v in own]
        model.splits.append(splits)
        model.values.append(values)
    return model


def _best(node: int, sums: dict, edges: list[list[float]]) -> tuple[tuple[int, float] | None, float, float]:
    """The cut of a node that gains most, and the values of both sides (the same on both without a cut)."""
    value = lambda g, h: -RATE * g / (h + L2)
    gain, out, at = 1e-6, None, (0.0, 0.0)
    for j, own in enumerate(edges):
        bins = sums.get((node, j))
        if not bins:
            continue
        g_all, h_all, n_all = (sum(x[i] for x in bins.values()) for i in range(3))
        if out is None and j == 0:
            at = (value(g_all, h_all),) * 2
        g = h = 0.0
        n = 0
        for k, cut in enumerate(own):
            x = bins.get(k, (0.0, 0.0, 0))
            g, h, n = g + x[0], h + x[1], n + x[2]
            if n < LEAST or n_all - n < LEAST:
                continue
            now = g * g / (h + L2) + (g_all - g) ** 2 / (h_all - h + L2) - g_all * g_all / (h_all + L2)
            if now > gain:
                gain, out, at = now, (j, cut), (value(g, h), value(g_all - g, h_all - h))
    return out, *at


@dataclass
class Filter:
    """Rules, and what has been learnt from the URLs that they judge."""

    rules: Sequence[Rule]
    statistics: DataFrame
    prior: float
    trees: Trees


def learn(pages: DataFrame, rules: Sequence[Rule] = RULES, sample: int = SAMPLE) -> Filter:
    """Trees and statistics from the URLs of ``pages`` that a rule fits. Beyond ``sample`` of them in the second half, those with the
    smallest hashes of their URL are taken, so that copies of one URL count once. Without any, or with one verdict alone, trees are
    empty, and all other URLs get the verdict of most of the labelled ones (allow without any)."""
    rows = parts(pages).withColumn("_rule", rule_of(rules)).where("_rule is not null").withColumn("block", ~F.col("_rule.allow"))
    rows = rows.select("url", "host", "path", "_query", "block")
    statistics = stash(suffix_statistics(rows), "suffixes")
    seen = rows.agg(F.count_if(_half(F.col("url")) == 1).alias("n"), F.avg(F.when(_half(F.col("url")) == 0, F.col("block").cast("int"))).alias("prior")).first()
    n, prior = seen["n"], 0.5 if seen["prior"] is None else float(seen["prior"])
    least = (1 << 30) if n <= sample else int(0.97 * sample / n * (1 << 30))
    taken = rows.where((_half(F.col("url")) == 1) & (F.pmod(F.xxhash64("url", F.lit("sample")), F.lit(1 << 30)) < least)).distinct()
    own = stash(with_features(taken, statistics, prior, F.lit(True)).select("block", *FEATURES).coalesce(4), "labelled")
    return Filter(rules, statistics, prior, grow(own))


def judge(pages: DataFrame, by: Filter) -> DataFrame:
    """``page_id, host, path, rule, verdict, score`` for each row of ``pages(page_id, url)``: the rule's verdict, or, where none fits, block
    if the trees give more than one half.

    A null url counts as empty. Long URLs are read whole; repeated rows stay rows and are judged alike; other columns, whatever their
    names, are ignored; an empty table gives no rows. ``score`` is null where a rule decides.
    """
    rows = with_features(parts(pages).withColumn("_rule", rule_of(by.rules)), by.statistics, by.prior, F.col("_rule").isNull())
    rows = rows.withColumn("score", F.when(F.col("_rule").isNull(), by.trees.score()))
    block = F.when(F.col("_rule").isNull(), F.col("score") > 0.5).otherwise(~F.col("_rule.allow"))
    return rows.select("page_id", "host", "path", F.col("_rule.name").alias("rule"), F.when(block, "block").otherwise("allow").alias("verdict"), "score")


def query(spark, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judge(pages, learn(pages))
