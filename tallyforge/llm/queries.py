"""The registered queries of the subpackage."""

from __future__ import annotations

from tallyforge.sources.tables import table


def op10_simhash_near_dedup(spark, sf_dir):
    from tallyforge.llm import simhash

    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op9_toxicity(spark, sf_dir):
    from tallyforge.llm import toxicity

    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, model, keep=["doc_id"])
    return scored.select("doc_id", toxicity.held_out().alias("held_out"), "score", "predicted")


def op5_best_fit_packing(spark, sf_dir):
    from tallyforge.llm import packing

    return packing.pack(table(spark, sf_dir, "documents"))


def op3_benchmark_decontamination(spark, sf_dir):
    from tallyforge.llm import decontaminate

    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_pii_pseudonyms(spark, sf_dir):
    from tallyforge.llm import pii

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.pseudonymise(docs, KEY, count_col="n_replaced")


def op4_virtual_slot_sharding(spark, sf_dir):
    from tallyforge.llm import sharding

    return sharding.assign(table(spark, sf_dir, "documents"))


def op7_substring_dedup(spark, sf_dir):
    from tallyforge.llm import substrings

    return substrings.remove_repeats(table(spark, sf_dir, "documents"))


def op6_exact_top_k(spark, sf_dir):
    from tallyforge.llm import topk

    vectors = table(spark, sf_dir, "embeddings")
    return topk.search(vectors, vectors.filter("vec_id % 100 = 0"))


def op8_language_id(spark, sf_dir):
    from tallyforge.llm import langid

    docs = table(spark, sf_dir, "documents")
    return langid.predict(docs, langid.train(docs))


def op1_licence_scan(spark, sf_dir):
    from pyspark.sql import functions as F

    from tallyforge.llm import licences

    files = licences.as_files(table(spark, sf_dir, "documents"))
    found = licences.scan(files, licence_file=F.col("speaks"))
    return found.withColumn("doc_id", F.regexp_extract("path", r"([0-9]+)\.txt$", 1).try_cast("long"))


def op11_lm_scoring(spark, sf_dir):
    from tallyforge.llm import lm

    return lm.score(table(spark, sf_dir, "documents"))


def op12_phrase_collocations(spark, sf_dir):
    from tallyforge.llm import phrases

    return phrases.mine(table(spark, sf_dir, "documents"))


OP12_SQL = r"""
    WITH pieces AS (SELECT lang, unnest(regexp_split_to_array(
             translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
             FROM (SELECT coalesce(lang, 'und') AS lang, text FROM documents)),
         worded AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
         total AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM worded GROUP BY lang),
         places AS (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM worded, (SELECT unnest([1, 2, 3, 4]) AS k)),
         f AS (SELECT lang, w[i:i + k - 1] AS w, k, count(*) AS n FROM places GROUP BY ALL HAVING count(*) >= 30),
         cuts AS (SELECT lang, w, k, n, unnest(range(1, k)) AS c FROM f WHERE k > 1),
         scored AS (SELECT q.lang, q.w, q.n AS a, q.c, x.n AS l, y.n AS r,
                           (CAST(2000000 AS HUGEINT) * q.n) // (CAST(x.n AS HUGEINT) + y.n) AS score
                    FROM cuts q JOIN f x ON x.lang = q.lang AND x.w = q.w[1:q.c]
                                JOIN f y ON y.lang = q.lang AND y.w = q.w[q.c + 1:q.k]),
         worst AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, w ORDER BY score, c) = 1),
         inner_ AS (SELECT lang, w[i:i + m - 1] AS w, max(n) AS around
                    FROM (SELECT lang, w, k, n, m, unnest(range(1, k - m + 2)) AS i
                          FROM f, (SELECT unnest([2, 3]) AS m) WHERE k > m) GROUP BY ALL),
         kept AS (SELECT lang, array_to_string(w, ' ') AS phrase, a, l, r, CAST(score AS BIGINT) AS score
                  FROM worst LEFT JOIN inner_ USING (lang, w) WHERE around IS NULL OR 100 * around < 80 * a)
    SELECT lang, rank, phrase, a, l, r, n, score
    FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
    JOIN total USING (lang) WHERE rank <= 2000"""


def op13_cross_tokenizer_alignment(spark, sf_dir):
    from tallyforge.llm import alignment

    return alignment.align(table(spark, sf_dir, "documents"))


#: The key of the registered query and the pipeline; real data need one of their own.
KEY = "registered-query"
QUERIES = {f.__name__: f for f in (op1_licence_scan, op2_pii_pseudonyms, op3_benchmark_decontamination,
                                  op4_virtual_slot_sharding, op5_best_fit_packing, op6_exact_top_k, op7_substring_dedup,
                                  op8_language_id, op9_toxicity, op10_simhash_near_dedup,
                                  op11_lm_scoring, op12_phrase_collocations, op13_cross_tokenizer_alignment)}
SQL: dict[str, str] = {"op12_phrase_collocations": OP12_SQL}
