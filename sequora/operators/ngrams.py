"""N-grams, transitions and contexts of token sequences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _n(df: DataFrame) -> Column:
    return F.col("n") if "n" in df.columns else F.lit(1)


def motifs(nodes: DataFrame, min_count: int, k: int, sizes: tuple[int, ...] = (2, 3, 4)) -> DataFrame:
    """The ``k`` most frequent n-grams of a node table: ``seq``, ``label``, ``cnt``.

    Every node adds its total to the n-grams that end at it. Ties go by label.
    """
    size = F.explode(F.array(*map(F.lit, sizes)))
    rows = nodes.where(F.col("depth") >= min(sizes)).select("path", "depth", "total", size.alias("size")).where("depth >= size")
    return (
        rows.groupBy(F.slice("path", F.col("depth") - F.col("size") + 1, F.col("size")).alias("seq")).agg(F.sum("total").alias("cnt"))
        .where(F.col("cnt") >= min_count).withColumn("label", F.array_join("seq", "")).orderBy(F.desc("cnt"), "label", "seq").limit(k)
    )


def legacy_motifs(nodes: DataFrame, min_count: int, top: int = 300, kept: int = 200, shown: int = 100) -> DataFrame:
    """The order of cuts of the legacy mode: top n-grams first, then the minimum, then two limits."""
    return motifs(nodes, 0, top).where(F.col("cnt") >= min_count).orderBy(F.desc("cnt"), "label", "seq").limit(min(kept, shown))


def tag_motifs(nodes: DataFrame, found: DataFrame, k: int = 50) -> DataFrame:
    """``(path, labels)``: the top ``k`` motifs that each node is part of.

    A motif that is the end of a node's path tags every node of that end. ``k`` rows are broadcast.
    """
    top = found.orderBy(F.desc("cnt"), "label", "seq").limit(k).select("seq", "label", F.size("seq").alias("_n"))
    sizes = F.explode(F.sequence(F.lit(2), F.least(F.lit(4), F.col("depth"))))
    ends = nodes.where("depth >= 2").select("path", "depth", sizes.alias("_n")).withColumn("seq", F.slice("path", F.col("depth") - F.col("_n") + 1, F.col("_n")))
    hits = ends.join(F.broadcast(top), ["seq", "_n"])
    tagged = hits.select("label", F.explode(F.transform(F.sequence(F.col("depth") - F.col("_n") + 1, F.col("depth")), lambda i: F.slice("path", 1, i))).alias("path"))
    return tagged.distinct().groupBy("path").agg(F.array_sort(F.collect_list("label")).alias("labels"))


def transition_matrix(nodes: DataFrame, min_p: float = 0.005, digits: int = 3) -> DataFrame:
    """``(src, dst, p)``: share of each following token, weighted by node totals; small shares are left out before rounding."""
    pairs = nodes.where("depth >= 2").groupBy(F.element_at("path", -2).alias("src"), F.col("token").alias("dst")).agg(F.sum("total").alias("w"))
    p = F.col("w") / F.sum("w").over(Window.partitionBy("src"))
    return pairs.withColumn("p", p).where(F.col("p") >= min_p).select("src", "dst", F.round("p", digits).alias("p"))


def token_frequency(seqs: DataFrame) -> DataFrame:
    """``(token, cnt, pct)``: how often each token occurs, and its share in percent."""
    counts = seqs.select(_n(seqs).alias("n"), F.explode("tokens").alias("token")).groupBy("token").agg(F.sum("n").cast("long").alias("cnt"))
    return counts.join(counts.agg(F.sum("cnt").alias("_all"))).withColumn("pct", F.round(100 * F.col("cnt") / F.col("_all"), 6)).drop("_all")


def sliding(seqs: DataFrame, size: int) -> DataFrame:
    """``(seq, cnt)``: n-grams counted in the sequences themselves."""
    grams = F.transform(F.sequence(F.lit(1), F.size("tokens") - (size - 1)), lambda i: F.slice("tokens", i, size))
    rows = seqs.where(F.size("tokens") >= size).select(_n(seqs).alias("n"), F.explode(grams).alias("seq"))
    return rows.groupBy("seq").agg(F.sum("n").cast("long").alias("cnt"))


def top_sliding(seqs: DataFrame, size: int, k: int) -> DataFrame:
    return sliding(seqs, size).withColumn("label", F.array_join("seq", "")).orderBy(F.desc("cnt"), "label", "seq").limit(k)


def length_distribution(seqs: DataFrame) -> DataFrame:
    """Per length: count and percent, beside the mean, the largest and the upper median of all lengths."""
    by = seqs.groupBy(F.size("tokens").alias("length")).agg(F.sum(_n(seqs)).cast("long").alias("cnt"))
    upto = F.sum("cnt").over(Window.orderBy("length"))  # one row a length
    cum = by.withColumn("upto", upto)
    whole = by.agg(F.sum("cnt").alias("_n"), F.round(F.sum(F.col("length") * F.col("cnt")) / F.sum("cnt"), 6).alias("mean"), F.max("length").alias("longest"))
    median = cum.join(whole).where(F.col("upto") > F.floor(F.col("_n") / 2)).agg(F.min("length").alias("median"))
    return by.join(whole).join(median).withColumn("pct", F.round(100 * F.col("cnt") / F.col("_n"), 6)).drop("_n")


def edge_tokens(seqs: DataFrame) -> DataFrame:
    """``(place, token, cnt, pct)``: first and last tokens, with their share of the sequences."""
    full = seqs.where(F.size("tokens") > 0).withColumn("_n", _n(seqs))
    ends = F.explode(F.array(F.struct(F.lit("first").alias("place"), F.element_at("tokens", 1).alias("token")), F.struct(F.lit("last").alias("place"), F.element_at("tokens", -1).alias("token"))))
    counts = full.select("_n", ends.alias("e")).groupBy("e.place", "e.token").agg(F.sum("_n").cast("long").alias("cnt"))
    return counts.join(full.agg(F.sum("_n").alias("_all"))).withColumn("pct", F.round(100 * F.col("cnt") / F.col("_all"), 6)).drop("_all")


def edge_only(seqs: DataFrame) -> DataFrame:
    """``(kind, token)``: tokens that begin sequences but never end one, and the reverse."""
    ends = edge_tokens(seqs)
    first, last = ends.where("place = 'first'").select("token"), ends.where("place = 'last'").select("token")
    return first.exceptAll(last).select(F.lit("onset_only").alias("kind"), "token").unionByName(last.exceptAll(first).select(F.lit("coda_only").alias("kind"), "token"))


def prefix_sharing(seqs: DataFrame, depths: tuple[int, ...] = (1, 2, 3), k: int = 10) -> DataFrame:
    """Per depth: distinct prefixes, sequences a prefix (over all sequences), and the ``k`` most frequent prefixes by rank."""
    n = _n(seqs)
    total = seqs.agg(F.sum(n).cast("long").alias("_all"))
    rows = seqs.select(n.alias("n"), "tokens", F.explode(F.array(*map(F.lit, depths))).alias("depth")).where(F.size("tokens") >= F.col("depth"))
    counts = rows.groupBy("depth", F.slice("tokens", 1, F.col("depth")).alias("seq")).agg(F.sum("n").cast("long").alias("cnt")).withColumn("prefix", F.array_join("seq", ""))
    per = counts.groupBy("depth").agg(F.count("*").alias("prefixes"))
    rank = F.row_number().over(Window.partitionBy("depth").orderBy(F.desc("cnt"), "prefix", "seq"))
    top = counts.withColumn("rank", rank).where(F.col("rank") <= k).drop("seq")
    return top.join(per, "depth").join(total).withColumn("avg_shared", F.round(F.col("_all") / F.col("prefixes"), 6)).drop("_all")


def summary_counts(seqs: DataFrame) -> DataFrame:
    """One row: sequences, distinct tokens, bigrams, trigrams, first and last tokens.

    One pass: each place of a sequence gives its n-grams, and an empty sequence gives one row without a gram.
    """
    size = F.size("tokens")
    places = seqs.select("tokens", _n(seqs).alias("n"), F.explode(F.sequence(F.lit(1), F.greatest(size, F.lit(1)))).alias("i"))
    rows = places.select("tokens", "n", "i", F.explode(F.array(*map(F.lit, (1, 2, 3)))).alias("k")).where((F.col("k") == 1) | (F.col("i") + F.col("k") - 1 <= size))
    starts = F.when((F.col("k") == 1) & (F.col("i") == 1), F.col("n"))
    grams = rows.groupBy("k", F.slice("tokens", F.col("i"), F.col("k")).alias("seq")).agg(
        F.sum(starts).alias("n"), F.max(F.col("i") == 1).alias("first"), F.max(F.col("i") == size).alias("last")
    ).withColumn("there", F.size("seq") == F.col("k"))
    of = lambda k: F.col("there") & (F.col("k") == k)
    return grams.agg(
        F.sum("n").cast("long").alias("sequences"), F.count_if(of(1)).alias("inventory"), F.count_if(of(2)).alias("bigrams"), F.count_if(of(3)).alias("trigrams"),
        F.count_if(of(1) & F.col("first")).alias("onsets"), F.count_if(of(1) & F.col("last")).alias("codas"),
    )


def contexts(aligned: DataFrame, maps: DataFrame) -> DataFrame:
    """``(grp, token, side, neighbour)`` as sorted arrays ``before`` and ``after`` of each mapped surface token.

    ``aligned`` has ``norm`` and ``surface``; ``maps(grp, token)`` names the surface tokens of interest. An
    edge counts as ``#``. The arrays hold distinct tokens of a group's inventory.
    """
    near = lambda i: F.coalesce(F.get("norm", i), F.lit("#"))
    places = F.transform("surface", lambda s, i: F.struct(s.alias("token"), near(i - 1).alias("before"), near(i + 1).alias("after")))
    rows = aligned.select("grp", F.explode(places).alias("x")).select("grp", "x.*").join(maps, ["grp", "token"], "left_semi")
    return rows.groupBy("grp", "token").agg(F.array_sort(F.collect_set("before")).alias("before"), F.array_sort(F.collect_set("after")).alias("after"))


def start_transitions(nodes: DataFrame, k: int = 16) -> DataFrame:
    """Depth-1 tokens with continuations: total, entropy, its maximum log2(children), and the ``k`` likeliest transitions by rank."""
    kids = nodes.where("depth = 2").select(F.element_at("path", 1).alias("start"), F.col("token").alias("next"), F.col("total").alias("next_total"))
    starts = nodes.where("depth = 1").select(F.col("token").alias("start"), "total")
    every = Window.partitionBy("start")
    p = F.col("next_total") / F.sum("next_total").over(every)
    rows = kids.withColumn("p", p).withColumns(
        {
            "entropy": F.round(-F.sum(F.col("p") * F.log2("p")).over(every), 6),
            "max_entropy": F.round(F.log2(F.count("*").over(every).cast("double")), 6),
            "rank": F.row_number().over(every.orderBy(F.desc("next_total"), "next")),
        }
    )
    return rows.where(F.col("rank") <= k).join(starts, "start").select("start", "total", "entropy", "max_entropy", "rank", "next", F.round("p", 6).alias("p"))
