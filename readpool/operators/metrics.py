"""Quality of a partition against known truth. pred: (read_id, cluster); truth: (read_id, label).

All metrics come from the contingency table, which is aggregated before anything else: its rows are pairs of a cluster and
a label that occur together, not reads. Reads without a label or cluster take no part. `positional` gives the table that
results if both partitions are written out as vectors in the order of their ids and compared place by place, which says
nothing of reads; it exists only to compare with figures computed so.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

GAMMAS = (0.6, 0.7, 0.8, 0.9, 0.95, 0.99, 1.0)


def contingency(pred: DataFrame, truth: DataFrame) -> DataFrame:
    """(cluster, label, n, first): reads in both, and the least of them."""
    rows = pred.select("read_id", "cluster").join(truth.select("read_id", "label"), "read_id")
    return rows.groupBy("cluster", "label").agg(F.count(F.lit(1)).alias("n"), F.min("read_id").alias("first"))


def positional(pred: DataFrame, truth: DataFrame) -> DataFrame:
    """(cluster, label, n) of the two partitions as vectors. Rows in the windows are clusters and labels, not reads."""

    def ends(rows: DataFrame, key: str, is_pred: bool) -> DataFrame:
        size = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
        upto = F.sum("n").over(Window.orderBy(key).rowsBetween(Window.unboundedPreceding, 0))
        return size.select(upto.alias("upto"), (F.col(key) if is_pred else F.lit(None)).cast("bigint").alias("c"), (F.lit(None) if is_pred else F.col(key)).cast("string").alias("l"))

    cuts = ends(pred, "cluster", True).unionByName(ends(truth, "label", False))
    cuts = cuts.groupBy("upto").agg(F.max("c").alias("c"), F.max("l").alias("l"))
    later = Window.orderBy("upto").rowsBetween(0, Window.unboundedFollowing)
    # Between two cuts lies one stretch of equal places: its labels are those of the next cuts on.
    n = F.col("upto") - F.coalesce(F.lag("upto").over(Window.orderBy("upto")), F.lit(0))
    parts = cuts.select(n.alias("n"), F.first("c", True).over(later).alias("cluster"), F.first("l", True).over(later).alias("label"))
    return parts.filter("cluster IS NOT NULL AND label IS NOT NULL").groupBy("cluster", "label").agg(F.sum("n").alias("n"))


def _judged(table: DataFrame) -> DataFrame:
    """(cluster, size, hits, true_size): hits are members with the label of the cluster's least read."""
    true_size = table.groupBy(F.col("label").alias("l")).agg(F.sum("n").alias("true_size"))
    per = table.groupBy("cluster").agg(F.sum("n").alias("size"), F.min(F.struct("first", "label", "n")).alias("f"))
    return per.select("cluster", "size", F.col("f.n").alias("hits"), F.col("f.label").alias("l")).join(true_size, "l").select("cluster", "size", "hits", "true_size")


def _passes(gamma: float):
    return (F.col("size") <= F.col("true_size")) & (F.col("hits") == F.col("size")) & (F.col("hits") >= F.lit(gamma) * F.col("true_size"))


def accuracy(table: DataFrame, gammas=GAMMAS) -> DataFrame:
    """(gamma, accuracy): the share of predicted clusters that hold one true cluster's reads only, and gamma of them."""
    flags = _judged(table).agg(*(F.avg(_passes(g).cast("double")).alias(f"g{i}") for i, g in enumerate(gammas)))
    rows = F.array(*(F.struct(F.lit(float(g)).alias("gamma"), F.col(f"g{i}").alias("accuracy")) for i, g in enumerate(gammas)))
    return flags.select(F.explode(rows).alias("r")).select("r.gamma", F.round("r.accuracy", 9).alias("accuracy"))


def diagnostics(table: DataFrame, gammas=GAMMAS) -> DataFrame:
    """(gamma, too_big, impure, not_big_enough): why clusters do not count for accuracy."""
    big = F.col("size") > F.col("true_size")
    impure = ~big & (F.col("hits") < F.col("size"))
    judged = _judged(table)
    sums = judged.agg(F.count_if(big).alias("too_big"), F.count_if(impure).alias("impure"), *(F.count_if(~big & ~impure & (F.col("hits") < F.lit(g) * F.col("true_size"))).alias(f"s{i}") for i, g in enumerate(gammas)))
    rows = F.array(*(F.struct(F.lit(float(g)).alias("gamma"), F.col(f"s{i}").alias("short")) for i, g in enumerate(gammas)))
    return sums.select("too_big", "impure", F.explode(rows).alias("r")).select("r.gamma", "too_big", "impure", F.col("r.short").alias("not_big_enough"))


def errors(table: DataFrame) -> DataFrame:
    """(n, fp, tn, fn, tp, ts) in one row: reads outside the true cluster of their cluster's least read, and true members
    outside the cluster of the label's least read. tn = n - fp and tp = n - fn."""
    fp = _judged(table).agg(F.sum("size").alias("n"), F.sum(F.col("size") - F.col("hits")).alias("fp"))
    per = table.groupBy("label").agg(F.sum("n").alias("size"), F.min(F.struct("first", "n"))["n"].alias("kept"))
    fn = per.agg(F.sum(F.col("size") - F.col("kept")).alias("fn"))
    both = fp.withColumn("fn", F.lit(0)).unionByName(fn.select(F.lit(0).alias("n"), F.lit(0).alias("fp"), "fn"))
    both = both.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n", "fp", "fn")))
    both = both.withColumn("tn", F.col("n") - F.col("fp")).withColumn("tp", F.col("n") - F.col("fn"))
    return both.select("n", "fp", "tn", "fn", "tp", F.round(F.col("tp") / (F.col("tp") + F.col("fn") + F.col("fp")), 9).alias("ts"))


def _margins(table: DataFrame) -> DataFrame:
    """One row: n, sums of x ln x and of pairs over cells, clusters and labels."""
    xlnx = lambda c: F.sum(F.col(c) * F.log(F.col(c).cast("double")))
    pairs = lambda c: F.sum(F.col(c) * (F.col(c) - 1) / 2)
    figures = [f"{k}_{c}" for c in ("cell", "pred", "true") for k in "hpkn"]

    def of(t: DataFrame, c: str) -> DataFrame:
        own = {f"h_{c}": xlnx("n"), f"p_{c}": pairs("n"), f"k_{c}": F.count(F.lit(1)), f"n_{c}": F.sum("n")}
        return t.agg(*(own.get(k, F.lit(None)).cast("double").alias(k) for k in figures))

    rows = of(table, "cell").unionByName(of(table.groupBy("cluster").agg(F.sum("n").alias("n")), "pred")).unionByName(of(table.groupBy("label").agg(F.sum("n").alias("n")), "true"))
    return rows.agg(*(F.max(k).alias(k) for k in figures))


def nmi(table: DataFrame) -> DataFrame:
    """(nmi): mutual information over the mean of both entropies; 1 where both have one class, 0 for no reads."""
    m, n = _margins(table), F.col("n_cell")
    entropy = lambda c: F.log(n.cast("double")) - F.col(f"h_{c}") / n
    mutual = entropy("pred") + entropy("true") - entropy("cell")
    mean = (entropy("pred") + entropy("true")) / 2
    value = F.when((F.col("k_pred") == 1) & (F.col("k_true") == 1), F.lit(1.0)).when(F.least("k_pred", "k_true") == 1, F.lit(0.0)).otherwise(mutual / mean)
    return m.select(F.round(F.coalesce(value, F.lit(0.0)), 9).alias("nmi"))


def ari(table: DataFrame) -> DataFrame:
    """(ari): the Rand index adjusted for chance; 1 where both partitions put all pairs alike."""
    m, n = _margins(table), F.col("n_cell")
    expected = F.col("p_pred") * F.col("p_true") / (n * (n - 1) / 2)
    value = (F.col("p_cell") - expected) / ((F.col("p_pred") + F.col("p_true")) / 2 - expected)
    same = (F.col("p_cell") == F.col("p_pred")) & (F.col("p_cell") == F.col("p_true"))
    return m.select(F.round(F.when(same | (n < 2), F.lit(1.0)).otherwise(value), 9).alias("ari"))


def purity(table: DataFrame) -> DataFrame:
    """(purity): the share of reads that have the commonest label of their cluster."""
    per = table.groupBy("cluster").agg(F.max("n").alias("best"), F.sum("n").alias("size"))
    return per.agg(F.round(F.sum("best") / F.sum("size"), 9).alias("purity"))


def report(seconds: float, counts: dict, metrics: dict[str, str]) -> str:
    """The text report: time, cluster counts, then each metric under its name."""
    head = [f"seconds: {seconds}", f"clusters: {counts['n_clusters']}, of a single read: {counts['n_singles']}"]
    return "\n".join(head + [f"{k}:\n{v}" for k, v in metrics.items()])


def accuracy_text(table: DataFrame) -> str:
    return "\n".join(f"{r['gamma']}: {r['accuracy']}" for r in accuracy(table).orderBy("gamma").collect())


def errors_text(table: DataFrame) -> str:
    r = errors(table).first()
    names = {"n": "reads", "fp": "false positives", "tn": "true negatives", "fn": "false negatives", "tp": "true positives", "ts": "threat score"}
    return "\n".join(f"{v}: {r[k]}" for k, v in names.items())


#: The metrics a report can hold, by name.
REGISTRY = {
    "accuracy": accuracy_text,
    "errors": errors_text,
    "nmi": lambda t: str(nmi(t).first()[0]),
    "ari": lambda t: str(ari(t).first()[0]),
    "purity": lambda t: str(purity(t).first()[0]),
}
DEFAULT_METRICS = ("accuracy", "errors", "nmi", "ari")

