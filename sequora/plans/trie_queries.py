"""Queries over prefix tries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.dims import LEGACY_VOWELS
from ..functions.scratch import shared_folder
from ..operators import trie as T
from ..sources import writers
from . import fixtures as fx
from .registry import ENT, LEX, NODES, VOWEL_LIST, query

V = fx.LETTER_VOWELS


def counts(spark, sf):
    return T.prefix_counts(fx.lexicon(spark, sf))


def nodes(spark, sf, min_count=2):
    return T.prune(T.prefix_nodes(counts(spark, sf)), min_count)


def place(spark):
    """A new folder beside the other scratch tables."""
    return f"{shared_folder(spark)}/{uuid.uuid4().hex}"


def flat(df, *columns):
    return df.select(T.label().alias("path"), *columns)


@query("tri01_prefix_counts", f"WITH {NODES} SELECT path, depth, grp, cnt, term FROM gn")
def _(spark, sf):
    return flat(counts(spark, sf), "depth", "grp", "cnt", "term")


@query("tri01_event_prefixes", """
WITH p AS (SELECT strftime(ts, '%Y-%m') AS grp, user_id, ts::DATE AS day, list(event_type ORDER BY ts, event_id) AS t FROM events GROUP BY ALL),
x AS (SELECT grp, t, unnest(range(0, len(t) + 1)) AS i FROM p)
SELECT grp, array_to_string(t[1:i], '>') AS path, i::INTEGER AS depth, count(*) AS cnt, count(*) FILTER (i = len(t)) AS term FROM x GROUP BY ALL""")
def _(spark, sf):
    return T.prefix_counts(fx.event_paths(spark, sf)).select("grp", F.array_join("path", ">").alias("path"), "depth", "cnt", "term")


@query("tri01_turn_prefixes_depth6", """
WITH p AS (SELECT conv_id, list(role ORDER BY turn) AS t FROM conversations GROUP BY conv_id),
x AS (SELECT t, unnest(range(0, least(len(t), 6) + 1)) AS i FROM p)
SELECT 'all' AS grp, array_to_string(t[1:i], '>') AS path, i::INTEGER AS depth, count(*) AS cnt, count(*) FILTER (i = len(t)) AS term FROM x GROUP BY ALL""")
def _(spark, sf):
    return T.prefix_counts(fx.turn_paths(spark, sf), max_depth=6).select("grp", F.array_join("path", ">").alias("path"), "depth", "cnt", "term")


@query("tri02_node_totals", f"""WITH {NODES}, kids AS (SELECT parent, count(*) AS n FROM kept WHERE depth > 0 GROUP BY parent)
SELECT path, depth, total, terminal, terminal > 0 AS is_terminal, coalesce(n, 0) AS child_count FROM kept LEFT JOIN kids ON kept.path = kids.parent""")
def _(spark, sf):
    return flat(T.with_child_count(nodes(spark, sf)), "depth", "total", "terminal", "is_terminal", "child_count")


@query("tri03_prune", f"WITH {NODES} SELECT path, depth, total FROM nodes WHERE total >= 50 OR depth = 0")
def _(spark, sf):
    return flat(nodes(spark, sf, 50), "depth", "total")


@query("tri04_preorder_ids", f"WITH {NODES} SELECT path, row_number() OVER (ORDER BY path) - 1 AS node_id FROM kept")
def _(spark, sf):
    return flat(T.node_ids(nodes(spark, sf)), "node_id")


@query("tri04_bfs_ids", f"WITH {NODES} SELECT path, row_number() OVER (ORDER BY depth, path) - 1 AS node_id FROM kept")
def _(spark, sf):
    return flat(T.node_ids(nodes(spark, sf), "bfs"), "node_id")


@query("tri05_edges", f"WITH {NODES} SELECT parent AS source, path AS target, token FROM kept WHERE depth > 0")
def _(spark, sf):
    return T.edges(nodes(spark, sf)).select(T.label("source").alias("source"), T.label("target").alias("target"), "token")


@query("tri06_transition_probs", f"WITH {NODES} SELECT parent AS source, path, round(total / sum(total) OVER (PARTITION BY parent), 6) AS p FROM kept WHERE depth > 0")
def _(spark, sf):
    return flat(T.transition_probs(nodes(spark, sf), 6), T.label("source").alias("source"), "p")


@query("tri06_legacy_rounding", f"WITH {NODES} SELECT path, round(total / sum(total) OVER (PARTITION BY parent), 4) AS p FROM kept WHERE depth > 0")
def _(spark, sf):
    return flat(T.transition_probs(nodes(spark, sf), 4), "p")


@query("tri07_entropy", f"WITH {NODES}, {ENT} SELECT path, branch, round(entropy, 6) AS entropy FROM ent")
def _(spark, sf):
    return flat(T.entropy(nodes(spark, sf)), "branch", F.round("entropy", 6).alias("entropy"))


@query("tri08_incoming_prob", f"""WITH {NODES}, p AS (SELECT parent, path, total / sum(total) OVER (PARTITION BY parent) AS p FROM kept WHERE depth > 0),
q AS (SELECT * FROM p WHERE p >= 0.01)
SELECT kept.path, round(CASE WHEN depth = 0 THEN 1 WHEN s.parent IS NULL THEN 0.5 ELSE coalesce(q.p, 0.05) END, 6) AS p_in
FROM kept LEFT JOIN (SELECT DISTINCT parent FROM q) s ON kept.depth > 0 AND s.parent = kept.parent LEFT JOIN q ON q.path = kept.path""")
def _(spark, sf):
    kept = nodes(spark, sf)
    probs = T.transition_probs(kept).where("p >= 0.01").select("source", F.col("path").alias("target"), "p")
    return flat(T.incoming_prob(kept, probs), F.round("p_in", 6).alias("p_in"))


WEIGHT = f"""WITH {NODES}, up AS (SELECT total, terminal, depth, path AS own, unnest(range(0, depth + 1)) AS i FROM kept)"""


@query("tri09_subtree_weights", f"{WEIGHT} SELECT substr(own, 1, i) AS path, sum(total)::BIGINT AS weight FROM up GROUP BY 1")
def _(spark, sf):
    return flat(T.subtree_weights(nodes(spark, sf)), "weight")


@query("tri09_legacy_weights", f"{WEIGHT} SELECT substr(own, 1, i) AS path, sum(greatest(total, 1))::BIGINT AS weight FROM up GROUP BY 1")
def _(spark, sf):
    return flat(T.subtree_weights(nodes(spark, sf), "legacy"), "weight")


ROLE = f"""CASE WHEN depth = 0 THEN 'mixed' WHEN contains('{VOWEL_LIST}', token) THEN 'nucleus' WHEN depth <= 1 THEN 'onset' WHEN terminal > 0 THEN 'coda' ELSE 'mixed' END"""


@query("tri10_roles", f"WITH {NODES} SELECT path, {ROLE} AS role, substr({ROLE}, 1, 1) AS role_code FROM kept")
def _(spark, sf):
    return flat(T.roles(nodes(spark, sf), V), "role", "role_code")


@query("tri10_legacy_roles", f"""WITH {NODES}, k AS (SELECT parent, bool_or(contains('{LEGACY_VOWELS}', token)) AS below FROM kept WHERE depth > 0 GROUP BY parent),
r AS (SELECT kept.*, coalesce(below, false) AS below, regexp_matches(substr(path, 1, greatest(depth - 1, 0)), '[{LEGACY_VOWELS}]') AS above FROM kept LEFT JOIN k ON k.parent = kept.path)
SELECT path, CASE WHEN depth = 0 THEN 'mixed' WHEN contains('{LEGACY_VOWELS}', token) THEN 'nucleus' WHEN depth = 1 THEN 'onset'
  WHEN NOT above AND below THEN 'onset' WHEN above AND NOT below THEN 'coda' WHEN above AND below THEN 'mixed' WHEN depth <= 3 THEN 'onset' ELSE 'coda' END AS role FROM r""")
def _(spark, sf):
    return flat(T.roles(nodes(spark, sf), LEGACY_VOWELS, "legacy"), "role")


@query("tri11_sample_words", f"WITH {LEX} SELECT grp, word AS path, word AS words FROM lex")
def _(spark, sf):
    return T.sample_words(fx.lexicon(spark, sf)).select("grp", T.label().alias("path"), F.array_join("words", ",").alias("words"))


@query("tri11_event_sample_keys", """
WITH p AS (SELECT strftime(ts, '%Y-%m') AS grp, user_id || '/' || (ts::DATE)::VARCHAR AS key, array_to_string(list(event_type ORDER BY ts, event_id), '>') AS path FROM events GROUP BY strftime(ts, '%Y-%m'), user_id, ts::DATE),
r AS (SELECT *, row_number() OVER (PARTITION BY grp, path ORDER BY key) AS k FROM p)
SELECT grp, path, string_agg(key, ',' ORDER BY key) AS words FROM r WHERE k <= 5 GROUP BY grp, path""")
def _(spark, sf):
    return T.sample_words(fx.event_paths(spark, sf)).select("grp", F.array_join("path", ">").alias("path"), F.array_join("words", ",").alias("words"))


SURF = r"""sw AS (SELECT lang AS grp, unnest(regexp_extract_all(text, '\p{L}+')) AS word FROM documents),
sl AS (SELECT grp, word, count(*) AS n, lower(word) AS lw FROM sw GROUP BY grp, word),
sf AS (SELECT *, CASE grp WHEN 'de' THEN translate(lw, 'äöü', 'aou') WHEN 'fr' THEN translate(lw, 'éèê', 'eee') ELSE lw END AS norm FROM sl),
sx AS (SELECT *, unnest(range(1, length(word) + 1)) AS i FROM sf)"""


@query("tri12_variants", f"WITH {SURF} SELECT substr(norm, 1, i) AS path, string_agg(DISTINCT substr(word, i, 1), ',' ORDER BY substr(word, i, 1)) AS variants FROM sx WHERE substr(word, i, 1) <> substr(norm, i, 1) GROUP BY 1")
def _(spark, sf):
    return flat(T.variants(fx.surfaces(spark, sf)), F.array_join("variants", ",").alias("variants"))


STATS = "round(coalesce(avg(branch), 0), 6) AS avg_branch, round(coalesce(avg(entropy), 0), 6) AS avg_entropy, round(coalesce(max(entropy), 0), 6) AS max_entropy"
FLAGSHIP_SQL = f"WITH {NODES}, {ENT} SELECT depth, count(*) AS nodes, count(*) FILTER (terminal > 0) AS terminals, {STATS} FROM kept LEFT JOIN ent USING (path) GROUP BY depth"


@query("tri13_depth_stats", FLAGSHIP_SQL)
def depth_stats(spark, sf):
    return T.depth_stats(nodes(spark, sf))


def group_sql(source, digits=6):
    return f"""{source}, ge AS (SELECT grp, substr(path, 1, depth - 1) AS path, count(*) AS branch,
  CASE WHEN count(*) > 1 THEN log2(sum(cnt)) - sum(cnt * log2(cnt)) / sum(cnt) ELSE 0.0 END AS entropy FROM g WHERE depth > 0 GROUP BY ALL),
gs AS (SELECT grp, depth, count(*) AS nodes, count(*) FILTER (term > 0) AS terminals, {STATS.replace(', 6)', f', {digits})')} FROM g LEFT JOIN ge USING (grp, path) GROUP BY grp, depth)"""


SHARED = group_sql(f"WITH {NODES}, g AS (SELECT gn.* FROM gn JOIN kept USING (path))")
OWN = group_sql(f"WITH {NODES}, g AS (SELECT * FROM gn)", 4)


@query("tri14_shared_group_stats", f"{SHARED} SELECT * FROM gs")
def shared_stats(spark, sf):
    return T.group_depth_stats(T.shared_counts(nodes(spark, sf)))


@query("tri15_own_group_stats", f"{OWN} SELECT * FROM gs")
def own_stats(spark, sf):
    return T.group_depth_stats(counts(spark, sf), 4)


INV = f"""inv AS (SELECT DISTINCT 'all' AS kind, token FROM kept WHERE depth > 0 UNION ALL SELECT DISTINCT 'onset', token FROM kept WHERE depth > 0 AND {ROLE} = 'onset'
UNION ALL SELECT DISTINCT 'coda', token FROM kept WHERE depth > 0 AND {ROLE} = 'coda')"""


@query("tri16_inventories", f"WITH {NODES}, {INV} SELECT * FROM inv")
def inventories(spark, sf):
    return T.inventories(T.roles(nodes(spark, sf), V))


@query("tri16_legacy_inventories", f"""WITH {NODES}, c AS (SELECT *, NOT contains('{VOWEL_LIST}', token) AS consonant FROM kept WHERE depth > 0)
SELECT DISTINCT 'initial' AS kind, token FROM c WHERE depth = 1 UNION ALL SELECT DISTINCT 'onset', token FROM c WHERE depth = 1 AND consonant
UNION ALL SELECT DISTINCT 'coda', token FROM c WHERE consonant AND terminal > 0""")
def _(spark, sf):
    return T.inventories(nodes(spark, sf), "legacy", V)


@query("tri17_metadata", f"""WITH {NODES} SELECT count(*) AS node_count, count(*) FILTER (depth > 0) AS edge_count, max(depth) AS max_depth, sum(terminal)::BIGINT AS total_words,
count(*) FILTER (terminal > 0) AS terminal_nodes, (SELECT count(DISTINCT grp) FROM lex)::INTEGER AS languages FROM kept""")
def _(spark, sf):
    return T.metadata(nodes(spark, sf))


@query("tri18_limited_summary", f"""WITH {NODES} SELECT count(*) FILTER (depth <= 6) AS kept_nodes, count(*) FILTER (depth BETWEEN 1 AND 6) AS kept_edges, sum(terminal) FILTER (depth <= 6)::BIGINT AS total_words,
count(*) AS total_nodes, count(*) FILTER (terminal > 0) AS terminal_nodes, max(depth) AS max_depth FROM kept""")
def _(spark, sf):
    return T.limited_summary(nodes(spark, sf), 6)


@query("tri19_labels", f"WITH {NODES} SELECT path AS label, depth FROM kept")
def _(spark, sf):
    return nodes(spark, sf).select(T.label().alias("label"), "depth")


@query("tri20_sharing_saving", f"""WITH {NODES}, w AS (SELECT DISTINCT word FROM lex), s AS (SELECT (sum(length(word)) + count(*))::BIGINT AS naive FROM w)
SELECT naive, (SELECT count(*) FROM nodes) AS nodes, naive - (SELECT count(*) FROM nodes) AS saved FROM s""")
def _(spark, sf):
    seqs = fx.lexicon(spark, sf)
    return T.sharing_saving(seqs, T.prefix_nodes(T.prefix_counts(seqs)))


@query("tri21_leaf_counts", f"""WITH {NODES}, leaf AS (SELECT path, depth FROM kept WHERE path NOT IN (SELECT parent FROM kept WHERE depth > 0)),
up AS (SELECT path AS own, unnest(range(0, depth + 1)) AS i FROM leaf) SELECT substr(own, 1, i) AS path, count(*) AS leaves FROM up GROUP BY 1""")
def _(spark, sf):
    return flat(T.leaf_counts(nodes(spark, sf)), "leaves")


@query("tri22_role_distribution", f"WITH {NODES}, r AS (SELECT {ROLE} AS role, depth FROM kept) SELECT role, depth, count(*) AS nodes FROM r GROUP BY role, depth UNION ALL SELECT role, NULL, count(*) FROM r GROUP BY role")
def _(spark, sf):
    return T.role_distribution(T.roles(nodes(spark, sf), V))


@query("tri17_metadata_lists", f"""WITH {NODES}, {INV} SELECT (SELECT string_agg(DISTINCT grp, ',' ORDER BY grp) FROM lex) AS languages, string_agg(token, ',' ORDER BY token) FILTER (kind = 'all') AS all_tokens,
string_agg(token, ',' ORDER BY token) FILTER (kind = 'onset') AS onset_tokens, string_agg(token, ',' ORDER BY token) FILTER (kind = 'coda') AS coda_tokens FROM inv""")
def _(spark, sf):
    kept = nodes(spark, sf)
    rows = T.metadata_lists(kept, T.inventories(T.roles(kept, V)))
    return rows.select(*[F.array_join(c, ",").alias(c) for c in rows.columns])


@query("tri22_variant_nodes", f"""WITH {SURF}, pre AS (SELECT norm, word, unnest(range(0, length(norm) + 1)) AS i FROM sf), n AS (SELECT DISTINCT substr(norm, 1, i) AS path FROM pre),
v AS (SELECT DISTINCT substr(norm, 1, i) AS path FROM sx WHERE substr(word, i, 1) <> substr(norm, i, 1))
SELECT length(n.path)::INTEGER AS depth, count(*) AS nodes, count(v.path) AS with_variants FROM n LEFT JOIN v USING (path) GROUP BY 1""")
def _(spark, sf):
    aligned = fx.surfaces(spark, sf)
    every = T.prefix_nodes(T.prefix_counts(aligned.select("grp", F.col("norm").alias("tokens"), "n")))
    return T.variant_nodes(every, T.variants(aligned))


COMPACT = f"""WITH {NODES}, q AS (SELECT parent, token, row_number() OVER (PARTITION BY parent ORDER BY total DESC, token) AS k FROM kept WHERE depth > 0),
t AS (SELECT parent, string_agg(token, ',' ORDER BY k) AS transitions FROM q WHERE k <= 5 GROUP BY parent)
SELECT path, depth, total, substr({ROLE}, 1, 1) AS role_code, coalesce(transitions, '') AS transitions, CASE WHEN terminal > 0 THEN path ELSE '' END AS words FROM kept LEFT JOIN t ON t.parent = kept.path WHERE depth <= 4"""


@query("snk7_compact_nodes", COMPACT)
def _(spark, sf):
    kept = nodes(spark, sf)
    probs = T.transition_probs(kept).groupBy(F.col("source").alias("path")).agg(F.map_from_entries(F.collect_list(F.struct("token", "p"))).alias("transition_probs"))
    words = T.sample_words(fx.lexicon(spark, sf).withColumn("grp", F.lit("all"))).drop("grp")
    path = place(spark)
    writers.export_compact(T.roles(kept, V).join(probs, "path", "left").join(words, "path", "left"), path, 4)
    rows = spark.read.json(path).withColumns({"path": F.coalesce("path", F.array().cast("array<string>")), "depth": F.col("depth").cast("int")})  # empty lists were left out
    listed = lambda tokens, name: F.coalesce(F.array_join(tokens, ","), F.lit("")).alias(name)
    return flat(rows, "depth", "total", "role_code", listed(F.col("transitions")["token"], "transitions"), listed(F.col("words"), "words"))


@query("snk8_nested_stats", f"{OWN} SELECT grp, count(*)::INTEGER AS depths, sum(nodes)::BIGINT AS nodes FROM gs GROUP BY grp")
def _(spark, sf):
    path = place(spark)
    writers.export_stats(own_stats(spark, sf), path)
    return spark.read.json(path).select("grp", F.size("stats").alias("depths"), F.aggregate("stats", F.lit(0).cast("long"), lambda a, x: a + x["nodes"]).alias("nodes"))
