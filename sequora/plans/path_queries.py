"""Queries over keyed prefixes: long sequences, and rows in order that no task gathers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scratch import materialize
from ..operators import paths as P
from . import fixtures as fx
from .registry import NODES, query
from .trie_queries import SURF


@query("tok2_numbered_events", """SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos,
  row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1 AS last FROM events""")
def _(spark, sf):
    events = fx.table(spark, sf, "events").select("user_id", "ts", "event_id")
    return P.numbered(events, ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "pos", "last")


USERS = """o AS (SELECT user_id, event_type AS token, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i, count(*) OVER (PARTITION BY user_id) AS size FROM events),
pre AS (SELECT *, md5(list_aggregate(list(token) OVER (PARTITION BY user_id ORDER BY i), 'string_agg', '>')) AS path FROM o),
node AS (SELECT path, i::INTEGER AS depth, token, count(*) AS cnt, count(*) FILTER (i = size) AS term FROM pre GROUP BY ALL)"""


@query("tri01_user_histories", f"WITH {USERS} SELECT depth, token, cnt, term, count(*) AS nodes FROM node GROUP BY ALL")
def _(spark, sf):
    prefixes = P.row_prefixes(fx.table(spark, sf, "events"), ["user_id"], "event_type", ["ts", "event_id"])
    return P.keyed_counts(prefixes).groupBy("depth", "token", "cnt", "term").agg(F.count("*").alias("nodes"))


def keyed(spark, sf):
    """Distinct words, their prefix rows, and the counts of nodes with a word that has each."""
    seqs = P.with_sids(fx.lexicon(spark, sf))
    return seqs, P.keyed_counts(P.array_prefixes(seqs), F.min("sid").alias("sid"))


def kept_nodes(spark, sf):
    seqs, counts = keyed(spark, sf)
    return seqs, P.keyed_nodes(counts, F.min("sid").alias("sid")).where("total >= 2")


def path_of(rows, seqs):
    return rows.join(seqs.select("sid", "tokens"), "sid").withColumn("path", F.array_join(F.slice("tokens", 1, F.col("depth")), ""))


@query("tri01_keyed_counts", f"WITH {NODES} SELECT path, depth, grp, cnt, term FROM gn WHERE depth > 0")
def _(spark, sf):
    seqs, counts = keyed(spark, sf)
    return path_of(counts, seqs).select("path", "depth", "grp", "cnt", "term")


@query("tri05_keyed_edges", f"WITH {NODES} SELECT path AS target, parent AS source, token FROM kept WHERE depth > 1")
def _(spark, sf):
    seqs, nodes = kept_nodes(spark, sf)
    named = path_of(nodes, seqs).select("k1", "k2", "path", "depth")
    edges = P.keyed_edges(nodes).join(named.where("depth > 1").select("k1", "k2", F.col("path").alias("target")), ["k1", "k2"])
    up = named.select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("path").alias("source"))
    return edges.join(up, ["p1", "p2"]).select("target", "source", "token")


@query("tri06_keyed_probs", f"WITH {NODES} SELECT path, round(total / sum(total) OVER (PARTITION BY parent), 6) AS p FROM kept WHERE depth > 0")
def _(spark, sf):
    seqs, nodes = kept_nodes(spark, sf)
    return path_of(P.keyed_probs(nodes), seqs).select("path", F.round("p", 6).alias("p"))


@query("tri12_keyed_variants", f"WITH {SURF} SELECT DISTINCT substr(norm, 1, i) AS path, substr(word, i, 1) AS surface FROM sx WHERE substr(word, i, 1) <> substr(norm, i, 1)")
def _(spark, sf):


    words = materialize(fx.surfaces(spark, sf).select("norm", "surface").withColumn("sid", F.monotonically_increasing_id()))
    return path_of(P.keyed_variants(words), words.select("sid", F.col("norm").alias("tokens"))).select("path", "surface").distinct()
