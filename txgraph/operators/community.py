"""Communities: label propagation (D11, D12, E4, E5) and modularity.

Both run on the *multigraph*: parallel edges count, a self-loop counts twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txgraph.functions.scalars import square
from txgraph.operators.views import vertex_ids, whole_edges
from txgraph.operators.written import write


def message_weights(edges: DataFrame) -> DataFrame:
    """``(f, t, w)``: how many label messages ``f`` sends ``t`` per round.

    Every edge row sends each end's label to the other end, so a pair's weight is
    its row count in both directions, and a self-loop row gives 2.
    """
    e = whole_edges(edges)
    sent = e.select(F.col("src").alias("f"), F.col("dst").alias("t")).unionByName(
        e.select(F.col("dst").alias("f"), F.col("src").alias("t")))
    return sent.groupBy("f", "t").agg(F.count(F.lit(1)).alias("w"))


def best_labels(hist: DataFrame) -> DataFrame:
    """E5: ``(id, new)``: the label with the largest ``n`` of each receiver of ``hist(t, label, n)``,
    ties to the smallest; one partial row per task per receiver."""
    return hist.groupBy("t").agg(
        F.min(F.struct((-F.col("n")).alias("neg_n"), F.col("label"))).alias("b")
    ).select(F.col("t").alias("id"), F.col("b.label").alias("new"))


def histogram_change(w: DataFrame, moved: DataFrame) -> DataFrame:
    """``(t, label, n)``: what the labels ``moved(id, old, label)`` change in the histograms of
    their receivers: their messages leave the old label and come to the new one."""
    out, into = F.struct(F.col("old").alias("label"), (-F.col("w")).alias("n")), F.struct("label", F.col("w").alias("n"))
    rows = w.join(moved.select(F.col("id").alias("f"), "old", "label"), "f").select(
        "t", F.explode(F.array(out, into)).alias("x")).select("t", "x.label", "x.n")
    return rows.groupBy("t", "label").agg(F.sum("n").alias("n")).filter(F.col("n") != 0)


def touched_histograms(w: DataFrame, changes: list[DataFrame]) -> DataFrame:
    """The histograms ``(t, label, n)`` of the receivers that the last of ``changes`` touched:
    the messages of the start, when everyone had their own label, and all changes since. The
    ``(t, label)`` grouping combines map-side and spreads a hub's histogram over many tasks."""
    rows = w.select("t", F.col("f").alias("label"), F.col("w").alias("n"))
    for change in changes:
        rows = rows.unionByName(change)
    hist = rows.join(changes[-1].select("t"), "t", "left_semi")
    return hist.groupBy("t", "label").agg(F.sum("n").alias("n")).filter(F.col("n") > 0)


def label_propagation(edges: DataFrame, max_steps: int = 5,
                      vertices: DataFrame | None = None) -> DataFrame:
    """Synchronous label propagation: ``(id, label)``.

    Start label = own id. Each round every vertex takes the label with the largest
    message weight (ties: smallest label). Stops early when no label changed, else
    after ``max_steps + 1`` rounds (the source counts steps down from ``max_steps`` to
    0 inclusive, so ``max_steps=5`` means up to six rounds).

    Divergence kept on purpose: a vertex without edges keeps its own label instead
    of being dropped. Histograms are maintained, not counted anew: a round sends messages only
    of the labels that changed, and looks again only at the receivers of those. What a round
    shuffles follows the number of changed labels; the message weights and the labels are written
    tables, which a small set of changes meets by broadcast. Large joins are plain shuffles,
    where the adaptive skew split deals the rows of hubs.
    """
    w, _ = write(message_weights(edges))
    labels, _ = write(vertex_ids(edges, vertices).select("id", F.col("id").alias("label")))
    best = best_labels(w.select("t", F.col("f").alias("label"), F.col("w").alias("n")))
    changes: list[DataFrame] = []
    for step in range(max_steps + 1):
        if step:
            change, _ = write(histogram_change(w, moved))
            changes.append(change)
            best = best_labels(touched_histograms(w, changes))
        labels, moves = write(labels.join(best, "id", "left").select(
            "id", F.coalesce("new", "label").alias("label"), F.col("label").alias("old")),
            F.col("label") != F.col("old"))
        if not moves:
            break
        moved = labels.filter(F.col("label") != F.col("old"))
        labels = labels.select("id", "label")
    return labels.select("id", "label")


def cluster_sizes(labels: DataFrame) -> DataFrame:
    """``(label, size)``; members stay a flat ``(id, label)`` table."""
    return labels.groupBy("label").agg(F.count(F.lit(1)).alias("size"))


def cluster_count(labels: DataFrame) -> DataFrame:
    """One row ``(clusters)``: number of distinct labels."""
    return labels.agg(F.count_distinct("label").alias("clusters"))


def label_pairs(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """``(ls, ld, n)``: edge rows per pair of end labels (the source's ``triplets``, counted); NULL
    for the label of an end that has none.

    The one pass over the multigraph that links, weights and modularity share. The labels are
    written once: broadcast when small, otherwise two plainly shuffled joins, in which the
    adaptive skew split deals the rows of hubs."""
    labels, _ = write(labels.select("id", "label"))
    e = whole_edges(edges).select("src", "dst")
    for end, name in (("src", "ls"), ("dst", "ld")):
        e = e.join(labels.select(F.col("id").alias(end), F.col("label").alias(name)), end, "left")
    return write(e.groupBy("ls", "ld").agg(F.count(F.lit(1)).alias("n")))[0]


def _labelled(edges: DataFrame, labels: DataFrame, pairs: DataFrame | None) -> DataFrame:
    p = label_pairs(edges, labels) if pairs is None else pairs
    return p.filter(F.col("ls").isNotNull() & F.col("ld").isNotNull())


def cluster_links(edges: DataFrame, labels: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """``(label, other, weight)``: intra-cluster edges on the diagonal (0.5 + 0.5
    each), every inter-cluster edge once in each direction with weight 1."""
    p = _labelled(edges, labels, pairs)
    rows = p.select(F.col("ls").alias("label"), F.col("ld").alias("other"), "n").unionByName(
        p.filter(F.col("ls") != F.col("ld"))
        .select(F.col("ld").alias("label"), F.col("ls").alias("other"), "n"))
    return rows.groupBy("label", "other").agg(F.sum("n").cast("double").alias("weight"))


def cluster_weights(edges: DataFrame, labels: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """Per cluster ``(label, intra, total)``: L_c = intra edges, total = L_c + X_c where
    X_c = inter-cluster edges touching c."""
    p = _labelled(edges, labels, pairs)
    zero = F.lit(0).cast("bigint")
    ends = p.select(F.col("ls").alias("label"), F.when(F.col("ls") == F.col("ld"), F.col("n"))
                    .otherwise(zero).alias("intra"), "n").unionByName(
        p.filter(F.col("ls") != F.col("ld")).select(F.col("ld").alias("label"), zero.alias("intra"), "n"))
    return ends.groupBy("label").agg(F.sum("intra").alias("intra"), F.sum("n").alias("total"))


def modularity(edges: DataFrame, labels: DataFrame, formula: str = "standard") -> DataFrame:
    """One row ``(modularity)``.

    ``m`` = all edge rows with both ends (parallel edges and self-loops included).
    ``half_intra`` (what the source computes): sum_c L_c/(2m) - ((L_c + X_c)/(2m))^2.
    ``standard`` (Clauset-Newman-Moore): sum_c L_c/m - ((2 L_c + X_c)/(2m))^2.
    Squares are summed as exact decimals; only the final ratio is a double.
    """
    if formula not in ("standard", "half_intra"):
        raise ValueError("formula must be 'standard' or 'half_intra'")
    pairs = label_pairs(edges, labels)
    cw = cluster_weights(edges, labels, pairs)
    if formula == "half_intra":
        sq, lin_div = square("total"), 2.0
    else:
        sq, lin_div = square(F.col("intra") + F.col("total")), 1.0
    per = cw.agg(F.sum("intra").alias("l"), F.sum(sq).alias("sq"))
    m = pairs.agg(F.coalesce(F.sum("n"), F.lit(0).cast("bigint")).alias("m"))
    from txgraph.plans.report import one_row

    r = one_row(per, m)
    m2 = 2.0 * F.col("m").cast("double")
    return r.select(
        (F.col("l").cast("double") / (lin_div * F.nullif(F.col("m").cast("double"), F.lit(0.0)))
         - F.col("sq").cast("double") / F.nullif(m2 * m2, F.lit(0.0))).alias("modularity"))
