"""Queries over n-grams, transitions, contexts and minimal pairs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.dims import SOUND_CLASSES
from ..functions.scratch import materialize
from ..operators import contrast as C
from ..operators import ngrams as N
from . import fixtures as fx
from .registry import LEX, NODES, query
from .trie_queries import SURF, flat, nodes

MOTIFS = f"""{NODES}, gram AS (SELECT substr(path, depth - s + 1, s) AS label, sum(total)::BIGINT AS cnt FROM kept, (VALUES (2), (3), (4)) AS z(s) WHERE depth >= s GROUP BY 1)"""


def spelled(df, *columns):
    return df.select(F.array_join("seq", "").alias("label"), *columns)


@query("ngr1_motifs", f"WITH {MOTIFS} SELECT label, cnt FROM gram WHERE cnt >= 500 ORDER BY cnt DESC, label LIMIT 200")
def motifs(spark, sf):
    return spelled(N.motifs(nodes(spark, sf), 500, 200), "cnt")


@query("ngr1_legacy_motifs", f"WITH {MOTIFS}, t AS (SELECT * FROM gram ORDER BY cnt DESC, label LIMIT 300) SELECT label, cnt FROM t WHERE cnt >= 100 ORDER BY cnt DESC, label LIMIT 100")
def _(spark, sf):
    return spelled(N.legacy_motifs(nodes(spark, sf), 100), "cnt")


@query("ngr2_node_motifs", f"""WITH {MOTIFS}, t AS (SELECT label, length(label) AS s FROM gram WHERE cnt >= 500 ORDER BY cnt DESC, label LIMIT 50),
h AS (SELECT path, depth, label, s FROM kept JOIN t ON depth >= s AND substr(path, depth - s + 1, s) = label),
x AS (SELECT DISTINCT label, substr(path, 1, depth - s + unnest(range(1, s + 1))) AS path FROM h)
SELECT path, string_agg(label, ',' ORDER BY label) AS labels FROM x GROUP BY path""")
def _(spark, sf):
    kept = nodes(spark, sf)
    return flat(N.tag_motifs(kept, N.motifs(kept, 500, 200)), F.array_join("labels", ",").alias("labels"))


def matrix(digits):
    return f"""WITH {NODES}, w AS (SELECT substr(path, depth - 1, 1) AS src, token AS dst, sum(total) AS w FROM kept WHERE depth >= 2 GROUP BY 1, 2),
p AS (SELECT src, dst, w / sum(w) OVER (PARTITION BY src) AS p FROM w) SELECT src, dst, round(p, {digits}) AS p FROM p WHERE p >= 0.005"""


@query("ngr3_transition_matrix", matrix(3))
def _(spark, sf):
    return N.transition_matrix(nodes(spark, sf))


@query("ngr3_legacy_matrix", matrix(4))
def _(spark, sf):
    return N.transition_matrix(nodes(spark, sf), digits=4)


CHARS = f"{LEX}, ch AS (SELECT grp, word, n, unnest(range(1, length(word) + 1)) AS i FROM lex)"


@query("ngr4_token_frequency", f"WITH {CHARS}, c AS (SELECT substr(word, i, 1) AS token, sum(n)::BIGINT AS cnt FROM ch GROUP BY 1) SELECT token, cnt, round(100 * cnt / (SELECT sum(cnt) FROM c), 6) AS pct FROM c")
def _(spark, sf):
    return N.token_frequency(fx.lexicon(spark, sf))


def sliding(size, k):
    return f"WITH {CHARS} SELECT substr(word, i, {size}) AS label, sum(n)::BIGINT AS cnt FROM ch WHERE i + {size} - 1 <= length(word) GROUP BY 1 ORDER BY cnt DESC, label LIMIT {k}"


@query("ngr5_top_bigrams", sliding(2, 30))
def _(spark, sf):
    return spelled(N.top_sliding(fx.lexicon(spark, sf), 2, 30), "cnt")


@query("ngr6_top_trigrams", sliding(3, 20))
def _(spark, sf):
    return spelled(N.top_sliding(fx.lexicon(spark, sf), 3, 20), "cnt")


@query("ngr7_length_distribution", f"""WITH {LEX}, b AS (SELECT length(word)::INTEGER AS length, sum(n)::BIGINT AS cnt FROM lex GROUP BY 1), c AS (SELECT *, sum(cnt) OVER (ORDER BY length) AS upto FROM b),
w AS (SELECT sum(cnt) AS n, round(sum(length * cnt) / sum(cnt), 6) AS mean, max(length) AS longest FROM b)
SELECT length, cnt, round(100 * cnt / n, 6) AS pct, mean, longest, (SELECT min(length) FROM c WHERE upto > n // 2) AS median FROM b, w""")
def _(spark, sf):
    return N.length_distribution(fx.lexicon(spark, sf))


EDGES = f"""WITH {LEX}, e AS (SELECT 'first' AS place, substr(word, 1, 1) AS token, sum(n)::BIGINT AS cnt FROM lex GROUP BY 2 UNION ALL SELECT 'last', substr(word, length(word), 1), sum(n)::BIGINT FROM lex GROUP BY 2)"""


@query("ngr8_edge_tokens", f"{EDGES} SELECT *, round(100 * cnt / (SELECT sum(n) FROM lex), 6) AS pct FROM e")
def _(spark, sf):
    return N.edge_tokens(fx.lexicon(spark, sf))


@query("ngr9_edge_only", f"""{EDGES}, f AS (SELECT token FROM e WHERE place = 'first'), l AS (SELECT token FROM e WHERE place = 'last')
SELECT 'onset_only' AS kind, token FROM (FROM f EXCEPT FROM l) UNION ALL SELECT 'coda_only', token FROM (FROM l EXCEPT FROM f)""")
def _(spark, sf):
    return N.edge_only(fx.lexicon(spark, sf))


@query("ngr10_prefix_sharing", f"""WITH {LEX}, c AS (SELECT d::INTEGER AS depth, substr(word, 1, d) AS prefix, sum(n)::BIGINT AS cnt FROM lex, (VALUES (1), (2), (3)) AS z(d) WHERE length(word) >= d GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY depth ORDER BY cnt DESC, prefix) AS rank, count(*) OVER (PARTITION BY depth) AS prefixes FROM c)
SELECT *, round((SELECT sum(n) FROM lex) / prefixes, 6) AS avg_shared FROM r WHERE rank <= 10""")
def _(spark, sf):
    return N.prefix_sharing(fx.lexicon(spark, sf))


@query("ngr11_summary", f"""WITH {CHARS} SELECT (SELECT sum(n)::BIGINT FROM lex) AS sequences, count(DISTINCT substr(word, i, 1)) AS inventory, count(DISTINCT substr(word, i, 2)) FILTER (i < length(word)) AS bigrams,
count(DISTINCT substr(word, i, 3)) FILTER (i + 1 < length(word)) AS trigrams, count(DISTINCT substr(word, 1, 1)) AS onsets, count(DISTINCT substr(word, length(word), 1)) AS codas FROM ch""")
def _(spark, sf):
    return N.summary_counts(fx.lexicon(spark, sf))


@query("ctx1_contexts", f"""WITH {SURF}, m AS (SELECT grp, substr(word, i, 1) AS token, CASE WHEN i > 1 THEN substr(norm, i - 1, 1) ELSE '#' END AS b, CASE WHEN i < length(word) THEN substr(norm, i + 1, 1) ELSE '#' END AS a FROM sx
WHERE (grp = 'de' AND contains('äöü', substr(word, i, 1))) OR (grp = 'fr' AND contains('éèê', substr(word, i, 1))))
SELECT grp, token, string_agg(DISTINCT b, ',' ORDER BY b) AS before, string_agg(DISTINCT a, ',' ORDER BY a) AS after FROM m GROUP BY grp, token""")
def _(spark, sf):
    pairs = [(g, t) for g, m in fx.SURFACE_MAP.items() for t in m]
    found = N.contexts(fx.surfaces(spark, sf), spark.createDataFrame(pairs, "grp string, token string"))
    return found.select("grp", "token", F.array_join("before", ",").alias("before"), F.array_join("after", ",").alias("after"))


@query("ctx2_start_transitions", f"""WITH {NODES}, k AS (SELECT parent AS start, token AS next, total, total / sum(total) OVER (PARTITION BY parent) AS p FROM kept WHERE depth = 2),
w AS (SELECT *, round(-sum(p * log2(p)) OVER (PARTITION BY start), 6) AS entropy, round(log2(count(*) OVER (PARTITION BY start)), 6) AS max_entropy, row_number() OVER (PARTITION BY start ORDER BY total DESC, next) AS rank FROM k)
SELECT start, s.total, entropy, max_entropy, rank, next, round(p, 6) AS p FROM w JOIN kept s ON s.depth = 1 AND s.path = start WHERE rank <= 16""")
def _(spark, sf):
    return N.start_transitions(nodes(spark, sf))


BLANKS = f"""{LEX}, blank AS (SELECT grp, substr(word, 1, i - 1) AS before, substr(word, i + 1) AS after, substr(word, i, 1) AS token FROM (SELECT grp, word, unnest(range(1, length(word) + 1)) AS i FROM lex))"""
PAIRS = f"{BLANKS}, con AS (SELECT DISTINCT x.grp, x.token AS a, y.token AS b FROM blank x JOIN blank y ON x.grp = y.grp AND x.before = y.before AND x.after = y.after AND x.token < y.token)"
COMPL = f"""{PAIRS}, fr AS (SELECT grp, substr(word, i, 1) AS t, sum(n)::BIGINT AS f FROM (SELECT grp, word, n, unnest(range(1, length(word) + 1)) AS i FROM lex) GROUP BY 1, 2 HAVING sum(n) >= 50),
com AS (SELECT x.grp, x.t AS a, y.t AS b, x.f AS fa, y.f AS fb FROM fr x JOIN fr y ON x.grp = y.grp AND x.t < y.t ANTI JOIN con ON con.grp = x.grp AND con.a = x.t AND con.b = y.t)"""
_SAME = " OR ".join(f"(contains('{m}', substr(a, 1, 1)) AND contains('{m}', substr(b, 1, 1)))" for m in SOUND_CLASSES.values())
SIM = f"{COMPL}, sim AS (SELECT *, CASE WHEN substr(a, 1, 1) = substr(b, 1, 1) THEN 0.9 WHEN contains(a, b) OR contains(b, a) THEN 0.7 WHEN {_SAME} THEN 0.5 ELSE 0.0 END::DOUBLE AS sim FROM com)"


def complementary(spark, sf):
    seqs = materialize(fx.lexicon(spark, sf))
    return C.complementary_pairs(seqs, C.contrasting_pairs(C.blank_keys(seqs)))


@query("min1_templates", f"WITH {BLANKS} SELECT grp, before, after, token FROM blank")
def _(spark, sf):
    return C.templates(fx.lexicon(spark, sf)).select("grp", F.array_join("before", "").alias("before"), F.array_join("after", "").alias("after"), "token")


@query("min2_contrasting_pairs", f"WITH {PAIRS} SELECT * FROM con")
def _(spark, sf):
    return C.contrasting_pairs(C.blank_keys(materialize(fx.lexicon(spark, sf))))


@query("min3_complementary_pairs", f"WITH {COMPL} SELECT * FROM com")
def _(spark, sf):
    return complementary(spark, sf)


@query("min4_similarity", f"WITH {SIM} SELECT * FROM sim")
def _(spark, sf):
    return C.similarity(complementary(spark, sf))


@query("min5_suggested_map", f"WITH {SIM} SELECT grp, CASE WHEN fa >= fb THEN b ELSE a END AS token, CASE WHEN fa >= fb THEN a ELSE b END AS target, sim FROM sim WHERE sim >= 0.5")
def _(spark, sf):
    return C.suggested_map(C.similarity(complementary(spark, sf)))
