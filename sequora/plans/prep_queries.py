"""Queries over sources, tokens, normalisation and validation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dims, prep
from ..operators import lookup as L
from ..sources import readers
from . import fixtures as fx
from .registry import LEX, OUT, query
from .trie_queries import SURF

WORDS = r"SELECT lang AS grp, unnest(regexp_extract_all(text, '\p{L}+')) AS word FROM documents"


@query("src1_lexicon_lines", f"WITH {LEX} SELECT word, grp AS transcription FROM lex")
def _(spark, sf):
    lines = fx.lexicon(spark, sf).select(F.concat_ws("\t", "key", F.concat(F.lit(" "), "grp"), F.lit("extra")).alias("line"))
    noise = lines.select(F.explode(F.array(F.col("line"), F.concat(F.lit("# "), "line"), F.lit("one field"), F.lit(""))).alias("line"))
    return readers.parse_lexicon(noise)


@query("src5_route_by_name", "SELECT doc_id, 'g' || right(source, 1) AS grp FROM documents WHERE source IS NOT NULL")
def _(spark, sf):
    rows = fx.table(spark, sf, "documents").select("doc_id", F.concat("source", F.lit("_broad.tsv")).alias("file"))
    sources = fx.table(spark, sf, "documents").where("source IS NOT NULL").select(F.col("source").alias("prefix")).distinct()
    return readers.route_by_name(rows, sources.withColumn("grp", F.concat(F.lit("g"), F.right("prefix", F.lit(1))))).select("doc_id", "grp")


@query("src6_checksums")
def _(spark, sf):
    return readers.checksums(spark, f"{sf}/*.parquet")


@query("tok1_tokens", f"WITH w AS ({WORDS}) SELECT DISTINCT word, array_to_string(string_split(word, ''), ' ') AS tokens FROM w")
def _(spark, sf):
    words = fx.table(spark, sf, "documents").select(F.explode(F.regexp_extract_all("text", F.lit(r"\p{L}+"), F.lit(0))).alias("word")).distinct()
    return words.select("word", F.array_join(prep.tokenize(F.concat(F.lit(" /"), "word", F.lit("/ "))), " ").alias("tokens"))


@query("tok1b_legacy_tokens", f"WITH w AS ({WORDS}) SELECT DISTINCT word, array_to_string(string_split(word, ''), ' ') AS tokens FROM w")
def _(spark, sf):
    words = fx.table(spark, sf, "documents").select(F.explode(F.regexp_extract_all("text", F.lit(r"\p{L}+"), F.lit(0))).alias("word")).distinct()
    return words.select("word", F.array_join(prep.tokenize(F.concat(F.lit("/["), "word", F.lit("]/")), "legacy"), " ").alias("tokens"))


@query("tok2_event_paths", """SELECT user_id || '/' || (ts::DATE)::VARCHAR AS key, array_to_string(list(event_type ORDER BY ts, event_id), '>') AS tokens FROM events GROUP BY user_id, ts::DATE""")
def _(spark, sf):
    return fx.event_paths(spark, sf).select("key", F.array_join("tokens", ">").alias("tokens"))


@query("nrm1_normalized", f"""WITH {LEX} SELECT grp, word AS key, CASE grp WHEN 'de' THEN translate(word, 'äöü', 'aou') WHEN 'fr' THEN translate(word, 'éèê', 'eee') ELSE word END AS norm FROM lex""")
def _(spark, sf):
    tokens = prep.normalized(F.col("tokens"), prep.map_of(fx.SURFACE_MAP, F.col("grp")))
    return fx.lexicon(spark, sf).select("grp", "key", F.array_join(tokens, "").alias("norm"))


@query("nrm2_collapses", f"WITH {SURF} SELECT grp, sum(n)::BIGINT AS collapses FROM sx WHERE substr(word, i, 1) <> substr(norm, i, 1) GROUP BY grp")
def _(spark, sf):
    return prep.collapsed(fx.surfaces(spark, sf)).where("collapses > 0")


@query("nrm3_rewrite", f"WITH {OUT} SELECT * FROM outcomes")
def _(spark, sf):
    return fx.outcomes(spark, sf)


INVENT = f"""{LEX}, ch AS (SELECT grp, word, n, unnest(range(1, length(word) + 1)) AS i FROM lex), lc AS (SELECT grp, substr(word, i, 1) AS token, sum(n) AS c FROM ch GROUP BY 1, 2),
inv AS (SELECT grp, token FROM (SELECT *, sum(c) OVER (PARTITION BY grp) AS s FROM lc) WHERE 200 * c >= s),
unk AS (SELECT ch.grp, ch.word, ch.n, i, substr(ch.word, i, 1) AS token FROM ch ANTI JOIN inv ON inv.grp = ch.grp AND inv.token = substr(ch.word, i, 1)),
chk AS (SELECT lex.*, coalesce(k, 0) AS issues FROM lex LEFT JOIN (SELECT grp, word, count(*) AS k FROM unk GROUP BY 1, 2) u USING (grp, word))"""


def checked(spark, sf):
    return prep.validate(fx.lexicon(spark, sf), fx.inventory(spark, sf))


@query("src4_inventory", f"WITH {INVENT} SELECT * FROM inv")
def _(spark, sf):
    return fx.inventory(spark, sf).select("grp", "token")


@query("val1_validate", f"""WITH {INVENT}, t AS (SELECT grp, word, string_agg('Unknown phoneme: ' || token, '; ' ORDER BY i) AS issues FROM unk GROUP BY grp, word)
SELECT chk.grp, chk.word AS key, coalesce(t.issues, '') AS issues, chk.issues = 0 AS valid FROM chk LEFT JOIN t USING (grp, word)""")
def _(spark, sf):
    return checked(spark, sf).select("grp", "key", F.array_join("issues", "; ").alias("issues"), "valid")


#: A decorated word: a stress mark first, length and aspiration on some letters, a tilde that composes with some, a tie to the next letter, and a
#: syllable border after the second letter; slashes around it. In Spark and in SQL, by the place of a letter (from 1).
MARKS = [(3, 0, "ː"), (4, 1, "ʰ"), (5, 2, "\u0303")]


def decorated(word):
    def one(c, i):
        sign = lambda m, r, s: F.when(i % m == r, F.lit(s)).otherwise(F.lit(""))
        tie = F.when((i % 6 == 4) & (i < F.length(word)), F.lit("\u0361")).otherwise(F.lit(""))
        return F.concat(c, *[sign(*m) for m in MARKS], tie, F.when(i == 2, F.lit(".")).otherwise(F.lit("")))

    letters = F.transform(prep.letters(word), lambda c, i: one(c, i + 1))
    return F.concat(F.lit(" /ˈ"), F.array_join(letters, ""), F.lit("/ "))


_SIGNS = " || ".join(f"CASE WHEN i % {m} = {r} THEN '{s}' ELSE '' END" for m, r, s in MARKS)
DECORATED = f"""{LEX}, chars AS (SELECT DISTINCT grp, word, i, substr(word, i, 1) || {_SIGNS} AS c FROM (SELECT grp, word, unnest(range(1, length(word) + 1)) AS i FROM lex)),
tied AS (SELECT grp, word, i, CASE WHEN i % 6 = 4 AND i < length(word) THEN c || '\u0361' || (SELECT x.c FROM chars x WHERE x.grp = chars.grp AND x.word = chars.word AND x.i = chars.i + 1) ELSE c END AS c FROM chars WHERE NOT (i % 6 = 5)),
tok AS (SELECT grp, word, 0 AS i, 'ˈ' AS t FROM lex UNION ALL SELECT grp, word, i, nfc_normalize(c) FROM tied UNION ALL SELECT grp, word, 2.5, '.' FROM lex WHERE length(word) >= 2)"""


@query("tok1_decorated", f"WITH {DECORATED} SELECT grp, word AS key, string_agg(t, ' ' ORDER BY i) AS tokens FROM tok GROUP BY grp, word")
def _(spark, sf):
    words = fx.lexicon(spark, sf).select("grp", "key", decorated(F.col("key")).alias("t"))
    return words.select("grp", "key", F.array_join(prep.tokenize(F.col("t")), " ").alias("tokens"))


@query("tok1b_legacy_decorated", f"WITH {DECORATED.replace('nfc_normalize(c)', 'c')} SELECT grp, word AS key, string_agg(t, ' ' ORDER BY i) AS tokens FROM tok GROUP BY grp, word")
def _(spark, sf):
    words = fx.lexicon(spark, sf).select("grp", "key", decorated(F.col("key")).alias("t"))
    return words.select("grp", "key", F.array_join(prep.tokenize(F.col("t"), "legacy"), " ").alias("tokens"))


#: Some tokens of decorated words are mapped as they are; all others lose nothing but prosody.
DECORATED_MAP = {"en": {"tʰ": "t", "hː": "h"}, "de": {"eʰ": "e", "nː": "n"}}
_MAPPED = " ".join(f"WHEN grp = '{g}' AND t = '{a}' THEN '{b}'" for g, pairs in DECORATED_MAP.items() for a, b in pairs.items())


@query("nrm1_decorated", f"WITH {DECORATED} SELECT grp, word AS key, string_agg(CASE {_MAPPED} ELSE t END, ' ' ORDER BY i) AS norm FROM tok WHERE t NOT IN ('ˈ', '.') GROUP BY grp, word")
def _(spark, sf):
    words = fx.lexicon(spark, sf).select("grp", "key", decorated(F.col("key")).alias("t"))
    norm = prep.normalized(prep.tokenize(F.col("t")), prep.map_of(DECORATED_MAP, F.col("grp")))
    return words.select("grp", "key", F.array_join(norm, " ").alias("norm"))


@query("val2_report", f"WITH {INVENT} SELECT grp, coalesce(sum(n) FILTER (issues = 0), 0)::BIGINT AS valid, sum(n)::BIGINT AS total, round(100 * coalesce(sum(n) FILTER (issues = 0), 0) / sum(n), 6) AS pct FROM chk GROUP BY ROLLUP (grp)")
def _(spark, sf):
    return prep.validation_report(checked(spark, sf))


@query("val2_unknown_tokens", f"WITH {INVENT} SELECT token, sum(n)::BIGINT AS cnt FROM unk GROUP BY token ORDER BY cnt DESC, token LIMIT 30")
def _(spark, sf):
    return prep.unknown_tokens(checked(spark, sf))


@query("cnt1_valid_counts", f"WITH {INVENT} SELECT grp, sum(n)::BIGINT AS cnt FROM chk WHERE issues = 0 GROUP BY grp")
def _(spark, sf):
    return prep.valid_counts(checked(spark, sf))


@query("cnt2_invalid_totals", f"WITH {INVENT} SELECT grp, coalesce(sum(n) FILTER (issues > 0), 0)::BIGINT AS invalid, sum(n)::BIGINT AS total FROM chk GROUP BY ROLLUP (grp)")
def _(spark, sf):
    return prep.invalid_totals(checked(spark, sf))


@query("flt1_valid_facts", f"WITH {INVENT} SELECT word AS key, array_to_string(string_split(word, ''), ' ') AS tokens FROM chk WHERE issues = 0 AND grp = 'de'")
def _(spark, sf):
    return L.valid_facts(checked(spark, sf), "de").select("key", F.array_join("tokens", " ").alias("tokens"))


@query("flt2_select_groups", f"WITH {LEX} SELECT grp, count(*) AS words FROM lex WHERE grp IN ('de', 'fr') GROUP BY grp")
def _(spark, sf):
    return L.select_groups(fx.lexicon(spark, sf), "de, fr,xx", dims.group_dim(spark, fx.LANGS)).groupBy("grp").agg(F.count("*").alias("words"))


@query("flt10_present_groups", """WITH g(code, name) AS (VALUES ('en', 'English'), ('de', 'German'), ('fr', 'French'), ('es', 'Spanish'), ('nl', 'Dutch'))
SELECT code, name FROM g WHERE code IN (SELECT lang FROM documents)""")
def _(spark, sf):
    groups = dims.group_dim(spark, [*fx.LANGS, ("nl", "Dutch", "Germanic", "Fusional", "nld")])
    return L.present_groups(groups, fx.table(spark, sf, "documents").select(F.col("lang").alias("grp"))).select("code", "name")


@query("nrm1b_legacy_aligned", f"""WITH {LEX} SELECT grp, word AS key, word AS surface, CASE grp WHEN 'de' THEN translate(word, 'äöü', 'aou') WHEN 'fr' THEN translate(word, 'éèê', 'eee') ELSE word END AS norm FROM lex""")
def _(spark, sf):
    marked = F.transform("tokens", lambda t: F.concat(t, F.lit("ˈ")))  # stress marks inside tokens go
    pairs = prep.normalized_pairs(F.concat(F.array(F.lit("ˌ")), marked), prep.map_of(fx.SURFACE_MAP, F.col("grp")), "legacy")
    rows = fx.lexicon(spark, sf).withColumn("p", pairs)
    joined = lambda name: F.array_join(F.transform("p", lambda x: x[name]), "").alias(name)
    return rows.select("grp", "key", F.translate(joined("surface"), "ˈ", "").alias("surface"), joined("norm"))
