"""URL filters by propagation over the link graph, with DataFrame functions only.

Rules (host, path) judge a url first: a rule fits its host and all subdomains of it, if the url's path starts with the
rule's; the longest rule (host and path together) wins. What no rule fits is judged by its host:

* edges between hosts come from the absolute links in the pages' html, counted once a page and target host;
* a host is a trusted (blocked) seed if rules allow (block) more than half of its pages;
* trust is a personalised PageRank from the trusted seeds along the links; distrust one from the blocked seeds against
  them, so that a host that links to blocked ones is distrusted. ``damping`` of a host's rank flows over its edges, in
  proportion to their counts; a seed that nothing flows to has rank 1, and what a host without edges would pass on is lost;
* a host is blocked if its distrust is above ``threshold`` and above its trust.

Each round is one join of the ranks with the edges by host and one sum by host; map-side sums hold up hosts that many
link to. Lineage is cut every third round by writing to the shared folder. The query iterates until the largest change of
a rank in a round is below ``TOLERANCE``; if that isn't so after ``MOST_ROUNDS``, it fails. Without edges between hosts, the ranks are
those of the seeds and no round is run.

Defined cases: a null url, or one without ``://``, has an empty host and path, no rule, and no part in the graph; its
verdict is allow. A null html has no links. Repeated pages count as often as they are there; extra columns are ignored;
an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.kernels import written

#: (host, path, verdict)
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]
MOST_IN_PLAN = 200
TOLERANCE, MOST_ROUNDS = 1e-9, 1000
LOW = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _after(url: Column) -> Column:
    return F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + F.lit(3), F.length(url))).otherwise("")


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(_after(F.coalesce(url, F.lit(""))), r"(?s)^([^/?#]*)", 1), *LOW)


def path_of(url: Column) -> Column:
    return F.regexp_extract(_after(F.coalesce(url, F.lit(""))), r"(?s)^[^/?#]*([^?#]*)", 1)


def ruled(pages: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """pages (host, path and others) with rule and rule_verdict. Up to MOST_IN_PLAN rules are conditions in the plan; more are joined by the suffixes of the host."""
    best = lambda conds: F.greatest(*conds, F.lit(None).cast("struct<n:int,rule:string,verdict:string>"))
    as_struct = lambda n, rule, verdict: F.struct(n.cast("int").alias("n"), rule.alias("rule"), verdict.alias("verdict"))
    if not rules:  # nothing fits
        return pages.withColumns({"rule": F.lit(None).cast("string"), "rule_verdict": F.lit(None).cast("string")})
    if len(rules) <= MOST_IN_PLAN:
        fits = [F.when(((F.col("host") == h) | F.col("host").endswith("." + h)) & F.col("path").startswith(p), as_struct(F.lit(len(h + p)), F.lit(h + p), F.lit(v))) for h, p, v in rules]
        out = pages.withColumn("_fit", best(fits))
        return out.withColumns({"rule": F.col("_fit.rule"), "rule_verdict": F.col("_fit.verdict")}).drop("_fit")
    table = pages.sparkSession.createDataFrame(rules, "rule_host string, rule_path string, verdict string")
    parts = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    keys = pages.select("host", "path").distinct()
    fit = keys.withColumn("rule_host", F.explode(suffixes)).join(table, "rule_host").where(F.col("path").startswith(F.col("rule_path")))
    fit = fit.groupBy("host", "path").agg(F.max(as_struct(F.length("rule_host") + F.length("rule_path"), F.concat("rule_host", "rule_path"), F.col("verdict"))).alias("_fit"))
    return pages.join(fit, ["host", "path"], "left").withColumns({"rule": F.col("_fit.rule"), "rule_verdict": F.col("_fit.verdict")}).drop("_fit")


def host_edges(pages: DataFrame) -> DataFrame:
    """src, dst, n (pages of src that link to dst) from pages (host, html)."""
    links = F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(r"""(?i)\shref\s*=\s*["']?\s*((?:https?:)?//[^"'\s>]+)"""), 1)
    hosts = F.array_distinct(F.transform(links, lambda u: F.translate(F.regexp_extract(u, r"//([^/?#]*)", 1), *LOW)))
    out = pages.where("host <> ''").select(F.col("host").alias("src"), F.explode(hosts).alias("dst")).where("dst <> '' and dst <> src")
    return out.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))


def personalised_pagerank(edges: DataFrame, seeds: DataFrame, damping: float = 0.85, rounds: int | None = None) -> DataFrame:
    """host, rank: the seeds' weights plus what flows in, damped, until no rank changes by TOLERANCE (or after so many rounds). edges: src, dst, n; seeds: host, weight."""
    out_n = edges.groupBy("src").agg(F.sum("n").alias("total"))
    share = written(edges.join(out_n, "src").select("src", "dst", (F.col("n") / F.col("total")).alias("share")), "edges")
    start = seeds.select("host", F.col("weight").alias("rank"))
    rank = start
    for i in range(MOST_ROUNDS if rounds is None else rounds):
        flow = rank.join(share, rank["host"] == share["src"]).select(F.col("dst").alias("host"), (damping * F.col("rank") * F.col("share")).alias("rank"))
        new = start.unionByName(flow)
        if i % 3 != 2:
            rank = new.groupBy("host").agg(F.sum("rank").alias("rank"))
            continue
        new = new.withColumn("before", F.lit(0.0)).unionByName(rank.select("host", F.lit(0.0).alias("rank"), F.col("rank").alias("before")))
        new = written(new.groupBy("host").agg(F.sum("rank").alias("rank"), F.sum("before").alias("before")), "rank")
        rank = new.select("host", "rank")
        if rounds is None and (new.agg(F.max(F.abs(F.col("rank") - F.col("before")))).first()[0] or 0.0) < TOLERANCE:
            break
    else:
        if rounds is None:
            raise RuntimeError(f"ranks still change by {TOLERANCE} or more after {MOST_ROUNDS} rounds")
    return rank


def judge(pages: DataFrame, rules: list[tuple[str, str, str]], damping: float = 0.85, rounds: int | None = None, threshold: float = 0.1) -> DataFrame:
    """pages (url, html and others) with host, path, rule, trust, distrust and verdict; rounds as in personalised_pagerank."""
    own = [c for c in pages.columns if c not in ("host", "path", "rule", "trust", "distrust", "verdict")]
    p = ruled(pages.select(*own).withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))}), rules)
    votes = p.where("host <> ''").groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("rule_verdict") == "allow").alias("allow"), F.count_if(F.col("rule_verdict") == "block").alias("block"))
    votes = written(votes.where("2 * allow > n or 2 * block > n"), "seeds")
    edges = written(host_edges(p), "host-edges")
    ranks = []
    linked = not edges.isEmpty()
    for name, seed, links in (("trust", "allow", edges), ("distrust", "block", edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "n"))):
        rank = votes.where(F.col(seed) * 2 > F.col("n")).select("host", F.lit(1.0).alias("weight"))
        if linked:
            rank = personalised_pagerank(links, rank, damping, rounds).withColumnRenamed("rank", "weight")
        ranks.append(rank.withColumnRenamed("weight", name))
    ranks = ranks[0].join(ranks[1], "host", "full").where(f"trust is not null or distrust > {threshold}")
    out = p.join(ranks, "host", "left").withColumns({c: F.coalesce(c, F.lit(0.0)) for c in ("trust", "distrust")})
    by_host = F.when((F.col("distrust") > threshold) & (F.col("distrust") > F.col("trust")), "block").otherwise("allow")
    return out.withColumn("verdict", F.coalesce("rule_verdict", by_host)).drop("rule_verdict")


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return judge(pages, RULES).select("page_id", "host", "path", "rule", "verdict", "trust", "distrust")
