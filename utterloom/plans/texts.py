"""Text functions over conversations and documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from utterloom.functions import numeric as nu
from utterloom.functions import text as tx
from utterloom.plans.registry import query, table

#: A stated keyword list with ranks, and a substitution table, of words that the test prose has.
RANKS = {"THE": 0, "OF": 2, "AND": 1, "DER": 5, "LA": 3, "QUE": 5, "IS": 1}
SUBS = {"THE": "A", "A": "THE", "IS": "ARE", "OF": "FROM", "DER": "DIE"}
CLASSES = {"THE": "article", "DER": "article", "LA": "article", "OF": "preposition", "DE": "preposition", "IS": "verb", "EST": "verb"}

VALUES = ", ".join(f"('{k}', {v})" for k, v in RANKS.items())
KEYS = "[" + ", ".join(f"'{k}'" for k in RANKS) + "]"
CLEAN = r"""list_filter(list_transform(list_filter(string_split_regex(coalesce(text, ''), '\s+'), lambda w: w <> ''), lambda w: ltrim(replace(upper(trim(w, ':"()')), 'ẞ', 'SS'), ',.!?;')), lambda w: w <> '')"""
CLAUSES = f"""w AS (SELECT conv_id, turn, {CLEAN} AS w FROM conversations),
c AS (SELECT conv_id, turn, list_filter(list_transform(string_split(array_to_string(list_transform(w, lambda x: CASE WHEN x = 'BUT' THEN chr(1) WHEN rtrim(x, ',.!?;') <> x THEN rtrim(x, ',.!?;') || ' ' || chr(1) ELSE x END), ' '), chr(1)), lambda s: trim(s)), lambda s: s <> '') AS c FROM w),
first AS (SELECT conv_id, turn, coalesce(list_filter(c, lambda s: list_has_any(string_split(s, ' '), {KEYS}))[1], c[1], '') AS clause FROM c)"""


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", tx.words(F.col("text")).alias("w"))


@query("tokenise_normalise", f"SELECT conv_id, turn, array_to_string({CLEAN}, ' ') AS words FROM conversations")
def tokenise_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns(spark, sf_dir).select("conv_id", "turn", F.array_join("w", " ").alias("words"))


@query("first_clause", f"WITH {CLAUSES} SELECT conv_id, turn, clause FROM first")
def first_clause(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns(spark, sf_dir).select("conv_id", "turn", F.array_join(tx.clause_with(F.col("w"), list(RANKS)), " ").alias("clause"))


@query(
    "keyword_rank",
    f"""WITH {CLAUSES}, k(word, rank) AS (VALUES {VALUES}),
    p AS (SELECT conv_id, turn, unnest(string_split(clause, ' ')) AS word, unnest(range(0, len(string_split(clause, ' ')))) AS pos FROM first),
    f AS (SELECT conv_id, turn, word, min(pos) AS pos FROM p GROUP BY ALL)
    SELECT conv_id, turn, word, rank, row_number() OVER (PARTITION BY conv_id, turn ORDER BY rank DESC, pos) AS place FROM f JOIN k USING (word)""",
)
def keyword_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keywords of each turn's clause, first occurrences, by rank and then position."""
    keys = spark.createDataFrame(list(RANKS.items()), "word string, rank int")
    clause = tx.clause_with(F.col("w"), list(RANKS))
    first = turns(spark, sf_dir).select("conv_id", "turn", F.posexplode(clause).alias("pos", "word")).groupBy("conv_id", "turn", "word").agg(F.min("pos").alias("pos"))
    place = F.row_number().over(Window.partitionBy("conv_id", "turn").orderBy(F.desc("rank"), "pos"))
    return first.join(F.broadcast(keys), "word").select("conv_id", "turn", "word", "rank", place.cast("long").alias("place"))


@query("substitute_words", "WITH s(word, other) AS (VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in SUBS.items()) + f"), t AS (SELECT conv_id, turn, unnest(w) AS word, unnest(range(0, len(w))) AS pos FROM (SELECT conv_id, turn, {CLEAN} AS w FROM conversations)) SELECT conv_id, turn, string_agg(coalesce(other, word), ' ' ORDER BY pos) AS words FROM t LEFT JOIN s USING (word) GROUP BY 1, 2")
def substitute_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns(spark, sf_dir).where(F.size("w") > 0).select("conv_id", "turn", F.array_join(tx.substitute(F.col("w"), SUBS), " ").alias("words"))


@query("pattern_decompose", rf"WITH t AS (SELECT conv_id, turn, array_to_string({CLEAN}, ' ') || ' ' AS s FROM conversations) SELECT conv_id, turn, trim(regexp_extract(s, '^((?:\S+ )*?)((?:OF|DE) )((?:\S+ ){{2}})((?:\S+ )*?)$', 1)) AS before, trim(regexp_extract(s, '^((?:\S+ )*?)((?:OF|DE) )((?:\S+ ){{2}})((?:\S+ )*?)$', 3)) AS two FROM t WHERE regexp_matches(s, '^((?:\S+ )*?)((?:OF|DE) )((?:\S+ ){{2}})((?:\S+ )*?)$')")
def pattern_decompose(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pattern (0 (* OF DE) 2 0): any run, one of two words, two words, any run."""
    from utterloom.operators.rules import compiled

    pattern = compiled((0, ("OF", "DE"), 2, 0), {})
    rows = turns(spark, sf_dir).select("conv_id", "turn", F.concat(F.array_join("w", " "), F.lit(" ")).alias("s")).where(F.col("s").rlike(pattern))
    return rows.select("conv_id", "turn", F.trim(F.regexp_extract("s", pattern, 1)).alias("before"), F.trim(F.regexp_extract("s", pattern, 3)).alias("two"))


@query("bag_of_classes", r"WITH k(word, class) AS (VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in CLASSES.items()) + r"), t AS (SELECT DISTINCT conv_id, turn, unnest(string_split_regex(upper(coalesce(text, '')), '[^\p{L}\p{N}'']+')) AS word FROM conversations), u AS (SELECT DISTINCT conv_id, turn, class FROM t JOIN k USING (word)) SELECT c.conv_id, c.turn, coalesce(string_agg(class, ',' ORDER BY class), '') AS bag FROM conversations c LEFT JOIN u ON c.conv_id = u.conv_id AND c.turn = u.turn GROUP BY 1, 2")
def bag_of_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    return rows.select("conv_id", "turn", F.array_join(tx.bag(F.col("text"), CLASSES), ",").alias("bag"))


@query("slug_dedupe", r"SELECT slug, min(page_id) AS page_id, count(*) AS n FROM (SELECT page_id, regexp_replace(url, '[^\p{L}\p{N}]', '_', 'g') AS slug FROM pages) GROUP BY 1")
def slug_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "pages").select("page_id", tx.slug(F.col("url")).alias("slug"))
    return rows.groupBy("slug").agg(F.min("page_id").alias("page_id"), F.count("*").alias("n"))


@query("file_names", r"SELECT page_id, regexp_replace(regexp_replace(regexp_replace(split_part(split_part(url, '?', 1), '#', 1), '^.*/', ''), '\.[^.]*$', ''), '[_.][0-9]+$', '') AS form FROM pages")
def file_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    plain = F.split_part(F.split_part(F.col("url"), F.lit("?"), F.lit(1)), F.lit("#"), F.lit(1))
    return table(spark, sf_dir, "pages").select("page_id", tx.form_of_file(plain).alias("form"))


@query("clip_id", "SELECT doc_id, substr(sha1(text), 1, 8) AS clip FROM documents")
def clip_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", nu.clip_id(F.col("text")).alias("clip"))


@query("mood_of_turn", "SELECT mood, count(*) AS n FROM (SELECT CASE WHEN ends_with(trim(text), '?') THEN 'Q' WHEN ends_with(trim(text), '!') THEN 'E' ELSE 'S' END AS mood FROM conversations) GROUP BY 1")
def mood_of_turn(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.trim(F.col("text"))
    mood = F.when(t.endswith("?"), "Q").when(t.endswith("!"), "E").otherwise("S")
    return table(spark, sf_dir, "conversations").groupBy(mood.alias("mood")).agg(F.count("*").alias("n"))


@query("score_log_parse", r"""WITH l AS (SELECT vec_id, CASE WHEN vec_id % 9 = 0 THEN 'noise ' || vec_id ELSE 'SCORE runtime=a set=' || (vec_id % 2) || ' name=v' || vec_id || ' q=' || array_to_string(list_transform(range(0, 4), lambda i: (vec_id * (i + 3)) % 257), ',') END AS line FROM embeddings),
p AS (SELECT regexp_extract(line, 'name=(\S+)', 1) AS name, regexp_extract(line, 'set=(\S+)', 1) AS "set", string_split(regexp_extract(line, 'q=(\S+)', 1), ',') AS q FROM l WHERE starts_with(line, 'SCORE '))
SELECT name, "set", i::BIGINT AS i, q[i + 1]::INTEGER / 256 AS p FROM p, range(0, 4) r(i)""")
def score_log_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log lines made from embeddings' ids, with noise between them, parsed into scores."""
    from utterloom.sources.logs import score_rows

    numbers = F.array_join(F.transform(F.array(*[F.lit(i) for i in range(4)]), lambda i: ((F.col("vec_id") * (i + 3)) % 257).cast("string")), ",")
    line = F.when(F.col("vec_id") % 9 == 0, F.concat(F.lit("noise "), F.col("vec_id").cast("string"))).otherwise(F.concat(F.lit("SCORE runtime=a set="), (F.col("vec_id") % 2).cast("string"), F.lit(" name=v"), F.col("vec_id").cast("string"), F.lit(" q="), numbers))
    rows = score_rows(table(spark, sf_dir, "embeddings").select(line.alias("value")))
    return rows.select("name", "set", F.posexplode("p").alias("i", "p")).withColumn("i", F.col("i").cast("long"))
