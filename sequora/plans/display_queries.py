"""Queries of cross-group tables and of lookups."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dims
from ..operators import dashboards as D
from ..operators import lookup as L
from ..operators import ngrams as N
from ..operators import stored_nodes as P
from ..operators import trie as T
from . import fixtures as fx
from .registry import ENT, LEX, NODES, query
from .trie_queries import INV, OWN, ROLE, SHARED, V, flat, inventories, nodes, own_stats, place, shared_stats

FIG = "fig AS (SELECT grp, arg_max(depth, nodes * 1000 - depth) AS peak_depth, max(nodes) AS peak_nodes, min(depth) FILTER (depth > 1 AND avg_branch < 2) AS convergence_depth, sum(nodes)::BIGINT AS nodes, sum(terminals)::BIGINT AS terminals, max(depth) AS max_depth, max(avg_branch) AS peak_branch, round(avg(avg_entropy), 6) AS mean_entropy FROM gs GROUP BY grp)"


@query("xgr1_group_figures", f"{SHARED}, {FIG} SELECT * FROM fig")
def _(spark, sf):
    return D.group_figures(shared_stats(spark, sf))


@query("xgr4_family_sections", f"""{SHARED}, {FIG}, d(grp, family, place) AS (VALUES ('en', 'Germanic', 1), ('de', 'Germanic', 1), ('fr', 'Romance', 2), ('es', 'Romance', 2))
SELECT family, place::INTEGER AS place, string_agg(grp, ',' ORDER BY grp) AS groups, sum(nodes)::BIGINT AS nodes FROM fig JOIN d USING (grp) GROUP BY family, place""")
def _(spark, sf):
    return D.family_sections(D.group_figures(shared_stats(spark, sf)), dims.group_dim(spark, fx.LANGS))


@query("xgr5_shell_dimension", f"""{OWN}, grps AS (SELECT DISTINCT grp FROM gs), grid AS (SELECT grp, unnest(range(1, 15))::INTEGER AS depth FROM grps)
SELECT grid.grp, grid.depth, round(coalesce(last_value(log2(nodes) IGNORE NULLS) OVER (PARTITION BY grid.grp ORDER BY grid.depth), 0), 6) AS dimension FROM grid LEFT JOIN gs ON gs.grp = grid.grp AND gs.depth = grid.depth""")
def _(spark, sf):
    return D.shell_dimension(own_stats(spark, sf))


@query("xgr6_shell_stats", f"""WITH {NODES}, s AS (SELECT depth, count(*) AS nodes, count(*) FILTER (terminal > 0) AS words, count(DISTINCT token) FILTER (terminal > 0) AS clusters FROM kept GROUP BY depth)
SELECT *, round(coalesce(nodes / lag(nodes) OVER (ORDER BY depth), 0), 6) AS ratio, round(log2(nodes), 6) AS entropy FROM s""")
def _(spark, sf):
    return D.shell_stats(nodes(spark, sf), "token")


@query("xgr8_chart_slice", f"{OWN} SELECT grp, depth, nodes, avg_branch FROM gs WHERE depth BETWEEN 1 AND 12")
def _(spark, sf):
    return D.chart_slice(own_stats(spark, sf), 12).select("grp", "depth", "nodes", "avg_branch")


_FEATURES = ", ".join(f"('{t}', '{p}', '{m}')" for t, _, p, m in dims.CONSONANTS)


def chart(spark, sf):
    first = nodes(spark, sf).where("depth = 1").groupBy("token").agg(F.sum("total").alias("freq"))
    return D.feature_chart(first, dims.consonant_dim(spark))


@query("xgr9_feature_chart", f"""WITH {NODES}, f(token, place, manner) AS (VALUES {_FEATURES}), k AS (SELECT token, sum(total) AS freq FROM kept WHERE depth = 1 GROUP BY token)
SELECT manner, place, coalesce(string_agg(f.token, ',' ORDER BY f.token) FILTER (freq IS NOT NULL), '') AS tokens, coalesce(sum(freq), 0)::BIGINT AS freq FROM f LEFT JOIN k USING (token) GROUP BY manner, place""")
def _(spark, sf):
    return chart(spark, sf)


PLACES = list(dict.fromkeys(p for _, _, p, _ in dims.CONSONANTS))
_PIVOT = ", ".join(f"max(t) FILTER (place = '{p}') AS \"{p}\"" for p in PLACES)


@query("xgr9_feature_pivot", f"""WITH {NODES}, f(token, place, manner) AS (VALUES {_FEATURES}), k AS (SELECT DISTINCT token FROM kept WHERE depth = 1),
c AS (SELECT manner, place, coalesce(string_agg(f.token, ',' ORDER BY f.token) FILTER (k.token IS NOT NULL), '') AS t FROM f LEFT JOIN k USING (token) GROUP BY manner, place)
SELECT manner, {_PIVOT} FROM c GROUP BY manner""")
def _(spark, sf):
    return D.feature_pivot(chart(spark, sf), PLACES)


_VOWELS = ", ".join(f"('{t}', '{h}', '{b}', {r})" for t, h, b, r in dims.VOWEL_FEATURES)


@query("xgr9_vowel_chart", f"""WITH {NODES}, f(token, height, backness, rounded) AS (VALUES {_VOWELS}), k AS (SELECT token, sum(total) AS freq FROM kept WHERE depth = 1 GROUP BY token)
SELECT height, backness, coalesce(string_agg(f.token, ',' ORDER BY f.token) FILTER (freq IS NOT NULL), '') AS tokens, coalesce(sum(freq), 0)::BIGINT AS freq FROM f LEFT JOIN k USING (token) GROUP BY height, backness""")
def _(spark, sf):
    first = nodes(spark, sf).where("depth = 1").groupBy("token").agg(F.sum("total").alias("freq"))
    return D.feature_chart(first, dims.vowel_dim(spark), "height", "backness")


@query("xgr10_token_class", f"""WITH {NODES}, {INV}, t AS (SELECT token, bool_or(kind = 'onset') AS o, bool_or(kind = 'coda') AS c FROM inv GROUP BY token)
SELECT token, CASE WHEN token IN ({", ".join(f"'{v[0]}'" for v in dims.VOWEL_FEATURES)}) THEN 'nucleus' WHEN c AND NOT o THEN 'coda' ELSE 'onset' END AS class FROM t""")
def _(spark, sf):
    return D.token_class(inventories(spark, sf), dims.vowel_dim(spark))


@query("xgr11_hubs", f"""WITH {NODES}, {ENT}, p AS (SELECT path AS label, depth, total, CASE WHEN terminal > 0 THEN 1000000 + total WHEN entropy > 2.5 AND branch >= 5 THEN 500000 + total END AS priority FROM kept LEFT JOIN ent USING (path) WHERE depth > 0)
SELECT * FROM p WHERE priority IS NOT NULL ORDER BY priority DESC, label LIMIT 80""")
def _(spark, sf):
    return D.hubs(nodes(spark, sf)).drop("path")


@query("xgr12_node_detail", f"""WITH {NODES}, k AS (SELECT token, total, total / sum(total) OVER () AS p, row_number() OVER (ORDER BY total DESC, token) AS r, row_number() OVER (ORDER BY token) AS s FROM kept WHERE parent = 'th' AND depth > 0)
SELECT path AS label, total, terminal, (SELECT string_agg(grp || ':' || cnt, ',' ORDER BY grp) FROM gn WHERE path = 'th') AS by_group, coalesce((SELECT string_agg(grp || ':' || term, ',' ORDER BY grp) FROM gn WHERE path = 'th' AND term > 0), '') AS ends_by_group,
(SELECT count(*) FROM k) AS n_children, (SELECT string_agg(token, ',' ORDER BY r) FROM k WHERE r <= 12) AS transitions, (SELECT string_agg(format('{{:.2f}}', 100 * p), ',' ORDER BY r) FROM k WHERE r <= 12) AS shares,
(SELECT string_agg(token, ',' ORDER BY s) FROM k WHERE s <= 30) AS children FROM kept WHERE path = 'th'""")
def _(spark, sf):
    return D.node_detail(nodes(spark, sf), ["t", "h"])


@query("xgr12_node_words", """WITH p AS (SELECT strftime(ts, '%Y-%m') AS grp, user_id || '/' || (ts::DATE)::VARCHAR AS key, array_to_string(list(event_type ORDER BY ts, event_id), '>') AS path FROM events GROUP BY strftime(ts, '%Y-%m'), user_id, ts::DATE),
r AS (SELECT *, row_number() OVER (PARTITION BY grp, path ORDER BY key) AS k FROM p WHERE path = 'click>view')
SELECT grp, string_agg(key, ',' ORDER BY key) AS words FROM r WHERE k <= 5 GROUP BY grp""")
def _(spark, sf):
    return D.node_words(T.sample_words(fx.event_paths(spark, sf)), ["click", "view"])


@query("xgr13_merged_edges", f"WITH {NODES} SELECT parent AS source, path AS target FROM kept WHERE depth BETWEEN 1 AND 5")
def _(spark, sf):
    every = T.edges(nodes(spark, sf))
    pages = [L.edges_by_depth(every, 0, 3), L.edges_by_depth(every, 1, 5)]
    return D.merged_edges(pages).select(T.label("source").alias("source"), T.label("target").alias("target"))


@query("xgr13_merged_nodes", f"WITH {NODES} SELECT path, CASE WHEN depth >= 3 THEN total * 2 ELSE total END::BIGINT AS total FROM kept WHERE depth <= 5")
def _(spark, sf):
    rows = nodes(spark, sf).select("path", "depth", "total")
    later = rows.where("depth BETWEEN 3 AND 5").withColumn("total", F.col("total") * 2)
    return D.merged_nodes([rows.where("depth <= 4"), later]).select(T.label().alias("path"), "total")


@query("flt3_node_by_id", f"WITH {NODES}, i AS (SELECT path, total, row_number() OVER (ORDER BY path) - 1 AS node_id FROM kept) SELECT * FROM i WHERE node_id = 100")
def _(spark, sf):
    return flat(L.node_by_id(T.node_ids(nodes(spark, sf)), 100), "total", "node_id")


@query("flt4_nodes_by_depth", f"""WITH {NODES}, r AS (SELECT path, depth, total FROM kept WHERE depth BETWEEN 2 AND 4)
SELECT *, (SELECT count(*) FROM r) AS total_count, (SELECT count(*) FROM r) > 600 AS has_more FROM (SELECT * FROM r ORDER BY depth, path LIMIT 500 OFFSET 100)""")
def _(spark, sf):
    return flat(L.nodes_by_depth(nodes(spark, sf), 2, 4, 100, 500), "depth", "total", "total_count", "has_more")


@query("flt4_stored_pages", f"""WITH {NODES}, r AS (SELECT path, depth, total, row_number() OVER (ORDER BY depth, path) - 1 AS k, count(*) OVER () AS c FROM kept WHERE depth BETWEEN 2 AND 9)
SELECT path, depth, total, c AS total_count, c > CASE WHEN k < 700 THEN 700 ELSE c END AS has_more FROM r WHERE k BETWEEN 400 AND 699 OR k >= c - 77""")
def _(spark, sf):
    path = place(spark)
    P.write_pages(nodes(spark, sf), path, 1000)
    one = P.page(spark, path, 2, 9, 400, 300)
    count = one.first().total_count
    return flat(one.unionByName(P.page(spark, path, 2, 9, count - 77, 500)), "depth", "total", "total_count", "has_more")


@query("flt5_children_of", f"WITH {NODES} SELECT path, total FROM kept WHERE parent = 'e' AND depth = 2")
def _(spark, sf):
    return flat(L.children_of(nodes(spark, sf), ["e"]), "total")


@query("flt6_parents", f"WITH {NODES} SELECT k.path, k.parent AS parent_path, p.total AS parent_total FROM kept k JOIN kept p ON k.depth > 0 AND p.path = k.parent")
def _(spark, sf):
    return flat(L.with_parent(nodes(spark, sf)), T.label("parent_path").alias("parent_path"), "parent_total")


@query("flt7_edges_by_depth", f"WITH {NODES} SELECT parent AS source, path AS target FROM kept WHERE depth BETWEEN 3 AND 4")
def _(spark, sf):
    found = L.edges_by_depth(T.edges(nodes(spark, sf)), 2, 4)
    return found.select(T.label("source").alias("source"), T.label("target").alias("target"))


def search_sql(q, n):
    return f"""WITH {NODES}, e AS (SELECT path, total FROM kept WHERE depth > 0 AND token = '{q}'), c AS (SELECT path, total FROM kept WHERE depth > 0 AND contains(token, '{q}') AND (SELECT count(*) FROM e) = 0),
u AS (SELECT * FROM (FROM e UNION ALL FROM c) ORDER BY path LIMIT {n}) SELECT *, (SELECT count(*) FROM u) AS total_matches FROM u"""


@query("flt8_search", search_sql("q", 50))
def _(spark, sf):
    return flat(L.search(nodes(spark, sf), "q"), "total", "total_matches")


@query("flt8_indexed_search", search_sql("q", 50))
def _(spark, sf):
    path = place(spark)
    P.write_index(nodes(spark, sf), path)
    return flat(P.search(spark, path, "q"), "total", "total_matches")


PAIRS_SQL = r"""WITH w AS (SELECT lang AS grp, unnest(regexp_extract_all(lower(text), '\p{L}+')) AS word FROM documents), x AS (SELECT DISTINCT word FROM w),
t AS (SELECT word, unnest(range(0, length(word) + 1, 2)) AS i FROM x), n AS (SELECT substr(word, 1, i) AS path, i FROM t UNION SELECT word, length(word) FROM x),
k AS (SELECT * FROM (SELECT path, CASE WHEN length(path) % 2 = 0 THEN right(path, 2) ELSE right(path, 1) END AS token FROM n WHERE path <> '') WHERE token <> 'ß')
"""


@query("flt8_indexed_inside", f"{PAIRS_SQL}, e AS (SELECT path, token FROM k WHERE contains(token, 'ß') ORDER BY token, path LIMIT 40) SELECT path, token, (SELECT count(*) FROM e) AS total_matches FROM e")
def _(spark, sf):
    path = place(spark)  # tokens are pairs of letters, so 'ß' is inside of some and is none unless a word ends with it at an odd place
    words = fx.lexicon(spark, sf).select(F.lit("all").alias("grp"), "key").distinct()
    pairs = F.transform(F.sequence(F.lit(1), F.length("key"), F.lit(2)), lambda i: F.substring("key", i, F.lit(2)))
    table = T.prefix_nodes(T.prefix_counts(words.select("grp", pairs.alias("tokens")))).where("token IS NULL OR token <> 'ß'")
    P.write_index(table, path)
    return flat(P.search(spark, path, "ß", 40), "token", "total_matches")


@query("flt9_visible", f"WITH {NODES} SELECT path, total FROM kept WHERE depth BETWEEN 1 AND 8 AND total >= 5 AND terminal > 0 AND {ROLE} IN ('nucleus', 'coda')")
def _(spark, sf):
    return flat(L.visible(T.roles(nodes(spark, sf), V), 8, True, ["nucleus", "coda"], 5), "total")


@query("flt11_stats_of", f"{SHARED} SELECT * FROM gs WHERE grp IN ('de', 'es')")
def _(spark, sf):
    return L.stats_of(shared_stats(spark, sf), ["de", "es"])


@query("flt12_ad_hoc", f"WITH {LEX} SELECT grp, count(*) AS words, sum(n)::BIGINT AS occurrences FROM lex GROUP BY grp")
def _(spark, sf):
    return L.ad_hoc({"lexicon": fx.lexicon(spark, sf)}, "SELECT grp, count(*) AS words, sum(n) AS occurrences FROM lexicon GROUP BY grp")


@query("xgr11_motif_hubs", f"""WITH {NODES}, {ENT}, gram AS (SELECT substr(path, depth - s + 1, s) AS label, sum(total) AS cnt, s FROM kept, (VALUES (2), (3), (4)) AS z(s) WHERE depth >= s GROUP BY 1, 3),
m AS (SELECT label, s FROM gram WHERE cnt >= 500 ORDER BY cnt DESC, label LIMIT 5), h AS (SELECT path, depth, s FROM kept JOIN m ON depth >= s AND substr(path, depth - s + 1, s) = label),
t AS (SELECT DISTINCT substr(path, 1, depth - s + unnest(range(1, s + 1))) AS path FROM h),
p AS (SELECT path AS label, depth, total, CASE WHEN terminal > 0 THEN 1000000 + total WHEN entropy > 2.5 AND branch >= 5 THEN 500000 + total END + CASE WHEN path IN (FROM t) THEN 100000 ELSE 0 END AS priority FROM kept LEFT JOIN ent USING (path) WHERE depth > 0)
SELECT * FROM p WHERE priority IS NOT NULL ORDER BY priority DESC, label LIMIT 80""")
def _(spark, sf):
    kept = nodes(spark, sf)
    return D.hubs(kept, motif_paths=N.tag_motifs(kept, N.motifs(kept, 500, 200), 5)).drop("path")


@query("xgr2_convergence_depth", f"{SHARED}, {FIG} SELECT grp, convergence_depth FROM fig")
def _(spark, sf):
    return D.group_figures(shared_stats(spark, sf)).select("grp", "convergence_depth")


@query("xgr3_group_totals", f"{SHARED}, {FIG} SELECT grp, nodes, terminals, max_depth, peak_branch FROM fig")
def _(spark, sf):
    return D.group_figures(shared_stats(spark, sf)).select("grp", "nodes", "terminals", "max_depth", "peak_branch")


@query("xgr7_mean_entropy", f"{OWN}, {FIG} SELECT grp, mean_entropy FROM fig")
def _(spark, sf):
    return D.group_figures(own_stats(spark, sf)).select("grp", "mean_entropy")
