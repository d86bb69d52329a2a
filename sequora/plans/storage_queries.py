"""Queries that write a table derived from the test tables and read it back."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import prep
from ..functions.scratch import materialize
from ..operators import live_trie
from ..operators import outcomes as O
from ..operators import seen
from ..operators import trie as T
from ..sources import readers, writers
from . import fixtures as fx
from .prep_queries import INVENT
from .registry import LEX, NODES, OUT, REPORT, query
from .survey_queries import SUBS, reports
from .trie_queries import nodes, place


def groups(words: DataFrame) -> list[str]:
    """The names of the groups: as few as there are languages. Rows without a group go to none."""
    return sorted(r.grp for r in words.where("grp IS NOT NULL").select("grp").distinct().collect())


@query("src2_dictionary", f"WITH {LEX} SELECT grp, word, reverse(word) AS transcription FROM lex")
def _(spark, sf):
    path, words = place(spark), fx.lexicon(spark, sf)
    line = F.concat_ws("\t", "key", F.reverse("key"))
    words.select(F.explode(F.array(line, F.concat(F.lit(";;; "), line), F.concat_ws("\t", F.concat("key", F.lit("(2)")), "key"))).alias("value"), "grp").write.partitionBy("grp").text(path)
    return reduce(DataFrame.union, [readers.read_dictionary(spark, f"{path}/grp={g}", g) for g in groups(words)])


@query("src3_multi_values", f"""WITH {LEX}, t AS (SELECT word, grp, unnest([word, word || 'ä']) AS x FROM lex)
SELECT grp, word AS key, CASE grp WHEN 'de' THEN translate(x, 'äöü', 'aou') WHEN 'fr' THEN translate(x, 'éèê', 'eee') ELSE x END AS norm, x AS surface FROM t""")
def _(spark, sf):
    path, words = place(spark), fx.lexicon(spark, sf)
    words.select(F.concat(F.col("key"), F.lit("\t/"), F.col("key"), F.lit("/, /"), F.col("key"), F.lit("ä/, //")).alias("value"), "grp").write.partitionBy("grp").text(path)
    rows = reduce(DataFrame.union, [readers.read_multi(spark, f"{path}/grp={g}", g, fx.SURFACE_MAP) for g in groups(words)])
    return rows.select("grp", "key", F.array_join("norm", "").alias("norm"), F.array_join("surface", "").alias("surface"))


@query("src4_read_inventory", f"WITH {INVENT} SELECT grp, token, false AS marginal FROM inv")
def _(spark, sf):
    path, rows = place(spark), fx.inventory(spark, sf).select("grp", "token")
    # The inventory with the least id counts; one with a larger id and empty tokens don't.
    row = lambda i, token: F.struct(F.lit(i).alias("InventoryID"), token.alias("Phoneme"))
    more = F.explode(F.array(row(7, F.col("token")), row(7, F.lit("")), row(12, F.concat("token", F.lit("x")))))
    rows.select(F.col("grp").alias("ISO6393"), more.alias("x")).select("x.InventoryID", "ISO6393", "x.Phoneme").write.csv(path, header=True)
    return readers.read_inventory(spark, path, {g: g for g in groups(rows)})


@query("src7_read_export", f"WITH {NODES} SELECT path, depth::BIGINT AS depth, total FROM kept")
def _(spark, sf):
    path, kept = place(spark), materialize(nodes(spark, sf))  # nodes, edges and metadata are made of them
    writers.export_trie(kept, T.edges(kept), T.metadata(kept), path)
    rows = readers.read_export(spark, path)["nodes"]  # the root's empty path was left out
    return rows.select(F.coalesce(F.array_join("path", ""), F.lit("")).alias("path"), "depth", "total")


@query("snk1_reload_group", f"WITH {LEX} SELECT grp, word AS key, (n + CASE WHEN grp = 'de' THEN 1 ELSE 0 END)::BIGINT AS n FROM lex WHERE grp <> 'fr'")
def _(spark, sf):
    path, words = place(spark), fx.lexicon(spark, sf).select("grp", "key", "n")
    writers.replace_partitions(words, path, ["grp"])
    writers.reload_groups(words.where("grp = 'de'").withColumn("n", F.col("n") + 1), path, "grp", ["de", "fr"])  # no rows for fr any more
    return writers.read_rows(spark, path).select("grp", "key", "n")


@query("snk2_insert_absent", f"WITH {LEX} SELECT DISTINCT word AS key, grp FROM lex")
def _(spark, sf):
    path, words = place(spark), fx.lexicon(spark, sf).select("key", "grp")
    writers.insert_absent(words.where("grp IN ('en', 'de')"), path, ["key", "grp"])
    writers.insert_absent(words, path, ["key", "grp"])
    return writers.read_rows(spark, path)


@query("snk3_replace_reports", f"WITH {REPORT} SELECT experiment, size, CASE WHEN size = 8 THEN 0 ELSE total END::BIGINT AS total FROM reports")
def _(spark, sf):
    path, rows = place(spark), reports(spark, sf).select("experiment", "size", "total")
    writers.replace_partitions(rows, path, ["experiment", "size"])
    writers.replace_partitions(rows.where("size = 8").withColumn("total", F.lit(0).cast("long")), path, ["experiment", "size"])
    return writers.read_rows(spark, path).select("experiment", "size", "total")


@query("snk3_replace_motifs", f"WITH {SUBS}, f AS (SELECT experiment, sub, min(size) AS size FROM sub GROUP BY ALL) SELECT experiment, size, count(*) AS new_motifs FROM f GROUP BY ALL")
def _(spark, sf):
    path, rows = place(spark), O.new_motifs(fx.outcomes(spark, sf))
    for _ in range(2):
        writers.replace_partitions(rows, path, ["experiment", "size"])
    return writers.read_rows(spark, path).select("experiment", "size", "new_motifs")


@query("snk5_motifs_by_size", f"WITH {SUBS}, f AS (SELECT experiment, sub, min(size) AS size FROM sub GROUP BY ALL) SELECT experiment, size, count(*) AS new_motifs FROM f GROUP BY ALL")
def _(spark, sf):
    path, rows = place(spark), materialize(fx.outcomes(spark, sf))
    for name, sizes in (("middle", "size BETWEEN 5 AND 8"), ("small", "size < 5"), ("large", "size > 8"), ("small", "size < 5")):  # in any order; a retry changes nothing
        seen.add_outcomes(rows.where(sizes), path, name)
    return seen.new_motifs(spark, path)


@query("snk4_append_outcomes", f"WITH {OUT} SELECT * FROM outcomes")
def _(spark, sf):
    path, rows = place(spark), fx.outcomes(spark, sf).select("experiment", "size", "input", "outcome", "steps", "status")
    writers.append_outcomes(rows.where("size <= 6"), path, "small")
    for _ in range(2):  # a retry adds nothing, and a second part of a pair leaves the first
        writers.append_outcomes(rows.where("size > 6 AND steps > 1"), path, "large")
    writers.append_outcomes(rows.where("size > 6 AND steps <= 1"), path, "rest")
    return writers.read_rows(spark, path).select("experiment", "size", "input", "outcome", "steps", "status")


@query("snk6_export_edges", f"WITH {NODES} SELECT parent AS source, path AS target, token FROM kept WHERE depth > 0")
def _(spark, sf):
    path, kept = place(spark), materialize(nodes(spark, sf))  # nodes, edges and metadata are made of them
    writers.export_trie(kept, T.edges(kept), T.metadata(kept), path)
    rows = readers.read_export(spark, path)["edges"]
    return rows.select(F.coalesce(F.array_join("source", ""), F.lit("")).alias("source"), F.array_join("target", "").alias("target"), "token")


@query("snk9_report_csv", f"""WITH {SUBS}, f AS (SELECT experiment, sub, min(size) AS size FROM sub GROUP BY ALL), m AS (SELECT experiment, size, count(*) AS motifs FROM f GROUP BY ALL),
r AS (SELECT experiment, size, count(*) AS total, count(DISTINCT outcome) AS distinct, round(count(DISTINCT outcome) / count(*), 6) AS ratio, count(*) FILTER (status = 'divergent') AS divergent, count(*) FILTER (status = 'explosive') AS explosive,
round(coalesce(avg(steps) FILTER (status = 'normal'), 0), 6) AS avg, coalesce(max(steps) FILTER (status = 'normal'), 0) AS max FROM outcomes GROUP BY ALL)
SELECT r.*, coalesce(motifs, 0) AS motifs FROM r LEFT JOIN m USING (experiment, size)""")
def _(spark, sf):
    path, rows = place(spark), fx.outcomes(spark, sf)
    both = O.size_report(rows).join(O.new_motifs(rows), ["experiment", "size"], "left").na.fill(0, ["new_motifs"])
    writers.export_report(both, path, by="experiment")
    return spark.read.csv(path, header=True, schema="size int, total long, distinct long, ratio double, divergent long, explosive long, motifs long, avg double, max int, experiment string")


LIVE = f"""{LEX}, now AS (SELECT grp, word, CASE WHEN grp = 'de' THEN n + 1 ELSE n END AS n FROM lex WHERE grp <> 'fr' AND NOT (grp = 'en' AND length(word) > 9)),
pre AS (SELECT grp, n, word, unnest(range(0, length(word) + 1)) AS i FROM now),
gn AS (SELECT substr(word, 1, i) AS path, i::INTEGER AS depth, grp, sum(n)::BIGINT AS cnt, coalesce(sum(n) FILTER (i = length(word)), 0)::BIGINT AS term FROM pre GROUP BY ALL)"""


def followed(spark, sf):
    """A trie after all groups came, one was deleted, one changed and one lost some of its sequences."""
    path, words = place(spark), materialize(fx.lexicon(spark, sf))
    live_trie.reload_groups(words, path, groups(words))
    live_trie.reload_groups(words.where("grp = 'en' AND length(key) <= 9"), path, ["en"])
    live_trie.reload_groups(words.where("grp = 'de'").withColumn("n", F.col("n") + 1), path, ["de", "fr"])
    return path


@query("tri01_reloaded_counts", f"WITH {LIVE} SELECT path, depth, grp, cnt, term FROM gn")
def _(spark, sf):
    return live_trie.counts(spark, followed(spark, sf)).select(T.label().alias("path"), "depth", "grp", "cnt", "term")


@query("tri03_reloaded_prune", f"WITH {LIVE} SELECT path, depth, sum(cnt)::BIGINT AS total FROM gn GROUP BY path, depth HAVING sum(cnt) >= 20 OR depth = 0")
def _(spark, sf):
    return live_trie.nodes(spark, followed(spark, sf), 20).select(T.label().alias("path"), "depth", "total")


@query("src1_lexicon_to_json", f"""WITH {INVENT}, ok AS (SELECT grp, word, n FROM chk WHERE issues = 0 AND length(word) > 0), pre AS (SELECT word, n, unnest(range(0, length(word) + 1)) AS i FROM ok),
nodes AS (SELECT substr(word, 1, i) AS path, i::BIGINT AS depth, sum(n)::BIGINT AS total, coalesce(sum(n) FILTER (i = length(word)), 0)::BIGINT AS terminal FROM pre GROUP BY ALL)
SELECT * FROM nodes WHERE total >= 3 OR depth = 0""")
def _(spark, sf):
    """The whole way: a lexicon file, tokens, norms, valid ones, a pruned trie, JSON, and back."""
    text, out, words = place(spark), place(spark), materialize(fx.lexicon(spark, sf))
    line = F.concat("key", F.lit("\t"), decorated_plainly(F.col("key")), F.lit("\t"), F.col("n").cast("string"))
    words.select(F.concat_ws("\n", F.concat(F.lit("# "), "grp"), line, F.lit("one field")).alias("value"), "grp").write.partitionBy("grp").text(text)
    parsed = reduce(DataFrame.union, [readers.read_lexicon(spark, f"{text}/grp={g}").select(F.lit(g).alias("grp"), F.col("word").alias("key"), "transcription") for g in groups(words)])
    tokens = prep.normalized(prep.tokenize(F.col("transcription")), prep.map_of({}, F.col("grp")))
    seqs = parsed.withColumn("tokens", tokens).join(words.select("grp", "key", "n"), ["grp", "key"])
    valid = prep.validate(seqs, fx.inventory_of(words)).where("valid AND size(tokens) > 0")
    kept = materialize(T.prune(T.prefix_nodes(T.prefix_counts(valid)), 3))  # nodes, edges and metadata are made of them
    writers.export_trie(kept, T.edges(kept), T.metadata(kept), out)
    rows = readers.read_export(spark, out)["nodes"]
    return rows.select(F.coalesce(F.array_join("path", ""), F.lit("")).alias("path"), "depth", "total", "terminal")


def decorated_plainly(word):
    """A word as a transcription: slashes around it, a stress mark first, a border after the second letter and spaces between letters."""
    spaced = F.array_join(prep.letters(word), " ")
    return F.concat(F.lit("/ˈ"), F.regexp_replace(spaced, r"^(\S+ \S+) ", "$1 . "), F.lit("/"))
