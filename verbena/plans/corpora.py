"""Corpora, tokens, masks and word lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verbena.operators.corpus import all_tests, assign_role, parse_dataset_name
from verbena.operators.lexicons import (
    coverage_by_dataset,
    lexicon_coverage,
    lexicon_overlap,
    lexicon_union,
    lines_with_lexicon,
    lines_without_lexicon,
    split_overlap,
    unseen_words,
)
from verbena.operators.masking import (
    mask_if_encoder,
    mask_random_tokens,
    mask_targets,
    mask_text,
    mask_word_tokens,
    mask_words_by_lists,
    mask_words_by_table,
    redraw_masks,
)
from verbena.operators.schedule import alternate_modes, assign_batches, shuffle_order
from verbena.operators.tokens import rebuild_text, tokenize
from verbena.plans.registry import query
from verbena.plans.tables import (
    BENCH,
    CONV,
    ROLES,
    SEED,
    STAND_INS,
    TOK,
    conversations,
    documents,
    lines,
    read,
    words_in,
    words_of,
)
from verbena.session import fresh_path, spread
from verbena.sources.corpora import read_corpus, read_test_passes, write_corpus


@query(
    "read_corpus",
    """SELECT 'train' AS role, source AS dataset, line AS text, count(*) AS n
    FROM (SELECT source, unnest(string_split(text, chr(10))) AS line FROM documents)
    GROUP BY ALL""",
)
def corpus_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "corpus")
    write_corpus(documents(spark, sf_dir, "source", "text"), path, dataset="source")
    corpus = read_corpus(spark, path, "train")
    return corpus.groupBy("role", "dataset", "text").agg(F.count("*").alias("n"))


@query(
    "read_lines",
    """SELECT source AS dataset, count(*) AS lines, 0::BIGINT AS first_line, 0::BIGINT AS gaps
    FROM (SELECT source, unnest(string_split(text, chr(10))) AS line FROM documents)
    GROUP BY source""",
)
def lines_numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The numbers of each file's lines run from 0 without a gap."""
    path = fresh_path(spark, "corpus +1")
    write_corpus(documents(spark, sf_dir, "source", "text"), path, dataset="source")
    files = read_corpus(spark, path, "train").groupBy("dataset", "path").agg(
        F.count("*").alias("lines"),
        F.min("line_no").alias("first_line"),
        (F.max("line_no") + 1 - F.countDistinct("line_no")).alias("gaps"),
    )
    return files.groupBy("dataset").agg(
        F.sum("lines").alias("lines"),
        F.max("first_line").alias("first_line"),
        F.sum("gaps").alias("gaps"),
    )


@query(
    "read_test_passes",
    """WITH lines AS (
      SELECT 'benchmark' AS dataset, unnest(string_split(text, chr(10))) AS line FROM benchmark
      UNION ALL
      SELECT 'conversations', unnest(string_split(text, chr(10))) FROM conversations)
    SELECT pass_no, l.dataset, line AS text, count(*) AS n
    FROM lines l JOIN (VALUES (0, 'benchmark'), (1, 'benchmark'), (2, 'conversations'),
                              (3, 'conversations')) AS p(pass_no, dataset)
      ON p.dataset = l.dataset
    GROUP BY ALL""",
)
def passes_of_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "all tests")
    for name in ("benchmark", "conversations"):
        write_corpus(spread(read(spark, sf_dir, name).select("text")), f"{path}/{name}")
    files = [f"{path}/{name}" for name in ("benchmark", "conversations") for _ in range(2)]
    passes = read_test_passes(spark, files)
    return passes.groupBy("pass_no", "dataset", "text").agg(F.count("*").alias("n"))


NAMED_PARTS = """named AS (
  SELECT p_partkey, lower(p_type) AS verb,
         CASE WHEN p_size % 2 = 0 THEN 'syn_' ELSE '' END AS syn,
         CASE WHEN p_size % 2 = 0 THEN '' WHEN p_size % 4 = 1 THEN 'transitive_' ELSE 'passive_' END
           AS construction,
         CASE WHEN p_size % 6 = 0 THEN 'ext' ELSE 'SVO-OSV' END AS word_order,
         CASE p_size % 3 WHEN 0 THEN 'dr' WHEN 1 THEN 'bv' ELSE 'wr' END AS task,
         CASE WHEN p_brand LIKE '%5' THEN '_gpt-bert' ELSE '' END AS variant
  FROM part)"""


@query(
    "parse_dataset_name",
    f"""WITH {NAMED_PARTS}
    SELECT p_partkey, syn || verb || '_' || construction || word_order || '_' || task
             || '_for_human_exp' || variant AS dataset,
           syn <> '' AS synthetic, verb,
           nullif(replace(construction, '_', ''), '') AS construction,
           word_order, task, nullif(substr(variant, 2), '') AS variant
    FROM named""",
)
def names_of_datasets(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size")
    name = F.concat(
        F.when(size % 2 == 0, "syn_").otherwise(""),
        F.lower("p_type"),
        F.lit("_"),
        F.when(size % 2 == 0, "").when(size % 4 == 1, "transitive_").otherwise("passive_"),
        F.when(size % 6 == 0, "ext").otherwise("SVO-OSV"),
        F.lit("_"),
        F.when(size % 3 == 0, "dr").when(size % 3 == 1, "bv").otherwise("wr"),
        F.lit("_for_human_exp"),
        F.when(F.col("p_brand").endswith("5"), "_gpt-bert").otherwise(""),
    )
    paths = read(spark, sf_dir, "part").select(
        "p_partkey", F.concat(F.lit("data/"), name, F.lit("/"), name, F.lit(".txt.gz")).alias("path")
    )
    return parse_dataset_name(paths, "path").drop("path")


@query(
    "assign_role",
    """SELECT doc_id, CASE source WHEN 'src1' THEN 'train' WHEN 'src2' THEN 'validation'
                     ELSE 'anchor' END AS role, md5(text) AS text_md5
    FROM documents""",
)
def roles_of_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return assign_role(docs, ROLES, default="anchor").select(
        "doc_id", "role", F.md5("text").alias("text_md5")
    )


@query(
    "all_tests",
    """SELECT 'benchmark' AS dataset, text FROM benchmark
    UNION ALL SELECT 'conversations', text FROM conversations""",
)
def bag_of_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return all_tests(
        {name: read(spark, sf_dir, name) for name in ("benchmark", "conversations")}, ["text"]
    )


@query("tokenize", f"WITH {TOK} SELECT doc_id, pos, token FROM tok")
def tokens_of_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenize(documents(spark, sf_dir), ["doc_id"])


def masked_sql(condition: str, source: str = TOK) -> str:
    return f"""WITH {source}
    SELECT doc_id, pos, CASE WHEN {condition} THEN '[MASK]' ELSE token END AS token,
           {condition} AS masked, CASE WHEN {condition} THEN token END AS target
    FROM tok"""


@query("mask_word_tokens", masked_sql(f"token IN ({words_of('own_a')})"))
def masked_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mask_word_tokens(tokenize(documents(spark, sf_dir), ["doc_id"]), STAND_INS["own_a"])


@query("mask_words_by_lists", masked_sql(f"token IN ({words_in(*STAND_INS)})"))
def masked_by_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = tokenize(documents(spark, sf_dir), ["doc_id"])
    return mask_words_by_lists(tokens, STAND_INS, list(STAND_INS))


@query(
    "mask_words_by_table",
    masked_sql("token IN (SELECT token FROM bench)", f"{TOK}, {BENCH}"),
)
def masked_by_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = tokenize(read(spark, sf_dir, "benchmark"), []).select(F.col("token").alias("word"))
    tokens = tokenize(documents(spark, sf_dir), ["doc_id"])
    return mask_words_by_table(tokens, listed, ["doc_id"])


@query(
    "mask_random_tokens",
    masked_sql(f"md5('{SEED}:0:' || doc_id || ':' || pos) < '26666666'"),
)
def masked_at_random(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mask_random_tokens(
        tokenize(documents(spark, sf_dir), ["doc_id"]), "doc_id", SEED, epoch=0
    )


PLACED = f"""placed AS (
  SELECT doc_id, source, epoch, (row_number() OVER (PARTITION BY source, epoch
           ORDER BY md5('{SEED}:' || epoch || ':' || doc_id), doc_id) - 1) // 8 AS batch
  FROM documents CROSS JOIN (VALUES (0), (1)) AS e(epoch))"""


def batches_of_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, source, epoch, batch: two epochs in batches of eight."""
    docs = read(spark, sf_dir, "documents").select(
        "doc_id", "source", F.explode(F.lit([0, 1])).alias("epoch")
    )
    placed = shuffle_order(docs, "source", "doc_id", SEED, "epoch")
    return assign_batches(placed, 8).select("doc_id", "source", "epoch", "batch")


@query(
    "mask_if_encoder",
    f"""WITH {TOK}, {PLACED}, seen AS (
      SELECT t.doc_id, p.epoch, t.pos, t.token,
             CASE WHEN (p.epoch + p.batch) % 2 = 0 THEN 'decoder' ELSE 'encoder' END AS mode
      FROM tok t JOIN placed p ON p.doc_id = t.doc_id)
    SELECT doc_id, epoch, mode, count(*) AS tokens, count(*) FILTER (hit) AS masked,
           coalesce(sum(pos) FILTER (hit), 0)::BIGINT AS places,
           sum(CASE WHEN hit THEN 6 ELSE length(token) END)::BIGINT AS letters
    FROM (SELECT *, token IN ({words_of('own_b')}) AND mode = 'encoder' AS hit FROM seen)
    GROUP BY ALL""",
)
def masked_in_encoder_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    modes = alternate_modes(batches_of_documents(spark, sf_dir))
    texts = documents(spark, sf_dir).join(modes, "doc_id")
    keys = ["doc_id", "epoch", "mode"]
    masked = mask_if_encoder(
        tokenize(texts, keys), lambda tokens: mask_word_tokens(tokens, STAND_INS["own_b"])
    )
    return masked.groupBy(*keys).agg(
        F.count("*").alias("tokens"),
        F.count_if("masked").alias("masked"),
        F.sum(F.when(F.col("masked"), F.col("pos")).otherwise(0)).alias("places"),
        F.sum(F.length("token")).alias("letters"),
    )


def sql_redraw(key: str) -> str:
    return f"""WITH {TOK}, {PLACED}, seen AS (
      SELECT t.doc_id, p.epoch, t.pos, md5({key} || t.doc_id || ':' || t.pos) < '26666666' AS hit
      FROM tok t JOIN placed p ON p.doc_id = t.doc_id)
    SELECT doc_id, epoch, count(*) FILTER (hit) AS masked,
           coalesce(sum(pos) FILTER (hit), 0)::BIGINT AS places
    FROM seen GROUP BY doc_id, epoch"""


def redrawn(spark: SparkSession, sf_dir: str, strategy: str) -> DataFrame:
    texts = documents(spark, sf_dir).join(batches_of_documents(spark, sf_dir), "doc_id")
    tokens = tokenize(texts, ["doc_id", "epoch", "batch"])
    masked = redraw_masks(tokens, "doc_id", SEED, strategy)
    return masked.groupBy("doc_id", "epoch").agg(
        F.count_if("masked").alias("masked"),
        F.sum(F.when(F.col("masked"), F.col("pos")).otherwise(0)).alias("places"),
    )


@query("redraw_masks", sql_redraw(f"'{SEED}:' || p.epoch || ':' || p.batch || ':'"))
def masks_drawn_anew(spark: SparkSession, sf_dir: str) -> DataFrame:
    return redrawn(spark, sf_dir, "per_batch")


@query("redraw_masks_once", sql_redraw(f"'{SEED}:'"))
def masks_drawn_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    return redrawn(spark, sf_dir, "once")


@query(
    "mask_targets",
    f"""WITH {TOK}, near AS (
      SELECT doc_id, pos, token, lag(token) OVER w AS p, lead(token) OVER w AS n
      FROM tok WINDOW w AS (PARTITION BY doc_id ORDER BY pos))
    SELECT doc_id, pos, token AS target,
           CASE WHEN p IN ({words_of('own_c')}) THEN '[MASK]' ELSE p END AS "left",
           CASE WHEN n IN ({words_of('own_c')}) THEN '[MASK]' ELSE n END AS "right"
    FROM near WHERE token IN ({words_of('own_c')})""",
)
def targets_of_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mask_targets(documents(spark, sf_dir), ["doc_id"], STAND_INS["own_c"])


@query(
    "rebuild_text",
    f"""WITH {TOK}, joined AS (
      SELECT doc_id, string_agg(token, ' ' ORDER BY pos) AS text FROM tok GROUP BY doc_id)
    SELECT d.doc_id, coalesce(j.text, '') AS text
    FROM (SELECT doc_id FROM documents UNION ALL SELECT -1) d LEFT JOIN joined j USING (doc_id)""",
)
def texts_rebuilt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents and one text without a token."""
    docs = documents(spark, sf_dir)
    tokens = tokenize(docs, ["doc_id"])
    empty = docs.agg(F.lit(-1).cast("long").alias("doc_id"))
    return rebuild_text(tokens, ["doc_id"], docs.select("doc_id").unionByName(empty))


@query(
    "mask_text",
    f"""WITH {TOK}, hidden AS (
      SELECT doc_id, string_agg(CASE WHEN token IN ({words_of('own_a')}) THEN '[MASK]'
                                     ELSE token END, ' ' ORDER BY pos) AS text
      FROM tok GROUP BY doc_id)
    SELECT d.doc_id, coalesce(h.text, '') AS text
    FROM documents d LEFT JOIN hidden h ON h.doc_id = d.doc_id""",
)
def texts_masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mask_text(documents(spark, sf_dir), STAND_INS["own_a"])


LINES = f"""lines AS (
  SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) - 1 AS line_no
  FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)), held AS (
  SELECT *, list_has_any(regexp_extract_all(lower(line), '[a-z]+'), [{words_of('own_a')}]) AS hit
  FROM lines)"""


@query("lines_with_lexicon", f"WITH {LINES} SELECT doc_id, line_no, line AS text FROM held WHERE hit")
def lines_held(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines_with_lexicon(lines(spark, sf_dir), STAND_INS["own_a"])


@query(
    "lines_without_lexicon",
    f"WITH {LINES} SELECT doc_id, line_no, line AS text FROM held WHERE NOT hit",
)
def lines_not_held(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines_without_lexicon(lines(spark, sf_dir), STAND_INS["own_a"])


def vocabularies(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The word lists of the three text tables."""
    texts = {
        "benchmark": read(spark, sf_dir, "benchmark"),
        "conversations": conversations(spark, sf_dir),
        "documents": documents(spark, sf_dir),
    }
    return {
        name: tokenize(df, []).select(F.col("token").alias("word")) for name, df in texts.items()
    }


ALL_WORDS = f"""{TOK}, {CONV}, {BENCH}, lists AS (
  SELECT DISTINCT 'benchmark' AS list, token AS word FROM bench
  UNION SELECT DISTINCT 'conversations', token FROM conv
  UNION SELECT DISTINCT 'documents', token FROM tok)"""


@query("lexicon_union", f"WITH {ALL_WORDS} SELECT DISTINCT word FROM lists")
def words_of_all_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexicon_union(list(vocabularies(spark, sf_dir).values()))


@query(
    "lexicon_overlap",
    f"""WITH {ALL_WORDS}, held AS MATERIALIZED (
      SELECT word, bool_or(list = 'benchmark') AS a, bool_or(list = 'conversations') AS b,
             bool_or(list = 'documents') AS c
      FROM lists GROUP BY word)
    SELECT 'benchmark' AS list_a, 'conversations' AS list_b, word FROM held WHERE a AND b
    UNION ALL SELECT 'benchmark', 'documents', word FROM held WHERE a AND c
    UNION ALL SELECT 'conversations', 'documents', word FROM held WHERE b AND c""",
)
def words_in_two_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexicon_overlap(vocabularies(spark, sf_dir))


@query(
    "unseen_words",
    f"""WITH {ALL_WORDS} SELECT word FROM lists WHERE list = 'conversations'
    EXCEPT SELECT word FROM lists WHERE list = 'documents'""",
)
def words_not_trained_on(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = vocabularies(spark, sf_dir)
    return unseen_words(lists["conversations"], lists["documents"])


SOURCES = [f"src{i}" for i in range(20)]
LEXICON_ROWS = ", ".join(f"('{n}', '{w}')" for n, ws in STAND_INS.items() for w in ws)
COVERAGE = f"""{TOK}, lex AS (SELECT * FROM (VALUES {LEXICON_ROWS}) AS v(lexicon, word)),
sources AS (SELECT DISTINCT source FROM tok),
hits AS (SELECT source, token, count(*) AS n FROM tok GROUP BY ALL),
coverage AS (
  SELECT s.source AS dataset, l.lexicon, l.word, coalesce(h.n, 0) AS hits
  FROM sources s CROSS JOIN lex l
  LEFT JOIN hits h ON h.source = s.source AND h.token = l.word)"""


def coverage_of_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "source", "text")
    tokens = tokenize(docs, ["source"]).withColumnRenamed("source", "dataset")
    return lexicon_coverage(tokens, STAND_INS)


@query("lexicon_coverage", f"WITH {COVERAGE} SELECT * FROM coverage")
def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage_of_sources(spark, sf_dir)


@query(
    "lexicon_coverage_by_dataset",
    f"""WITH {COVERAGE} SELECT lexicon, {", ".join(
        f"coalesce(sum(hits) FILTER (dataset = '{s}'), 0)::BIGINT AS {s}" for s in SOURCES)}
    FROM coverage GROUP BY lexicon""",
)
def coverage_pivoted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage_by_dataset(coverage_of_sources(spark, sf_dir), SOURCES)


@query(
    "split_overlap",
    f"""WITH {TOK}, {CONV}, test AS (SELECT token, count(*) AS n FROM conv GROUP BY token),
    judged AS (SELECT n, token IN (SELECT token FROM tok WHERE source = 'src1') AS seen FROM test)
    SELECT sum(n)::BIGINT AS test_tokens,
           coalesce(sum(n) FILTER (NOT seen), 0)::BIGINT AS unseen_tokens,
           count(*) AS test_types, count(*) FILTER (NOT seen) AS unseen_types,
           coalesce(sum(n) FILTER (NOT seen), 0) / sum(n) AS unseen_token_share,
           count(*) FILTER (NOT seen) / count(*) AS unseen_type_share
    FROM judged""",
)
def overlap_of_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "source", "text")
    train = assign_role(docs, {"src1": "train"}).select("role", "text")
    test = conversations(spark, sf_dir).select(F.lit("test").alias("role"), "text")
    return split_overlap(tokenize(train.unionByName(test), ["role"]))
