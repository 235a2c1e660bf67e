"""The operators applied to their whole tables with production parameters, and SQL for what SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shortlist.llm import collocations, decontaminate, exact, language, licenses, neardup, neural, pieces, quality, spelling, substrings, toxicity, warc
from shortlist.llm.common import Stage, is_held_out, table

#: The vocabulary file of the public tokenizer that op4 is bound to.
PIECES_FILE = "piece_bpe_32k.model"


def op1_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return substrings.remove_repeats(table(spark, folder, "documents"), length=400)


def op2_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.scan(table(spark, folder, "documents"))


def op3_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact.deduplicate(table(spark, folder, "documents"))


def op4_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    return pieces.digest_documents(table(spark, folder, "documents"), public_tokenizers.path(PIECES_FILE))


def op5_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op6_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    held = is_held_out("doc_id", 5, 0)
    model = quality.learn(docs, labels, ~held)
    scored = quality.score(docs, model, cut=0.3)
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op7_language(spark: SparkSession, folder: str) -> DataFrame:
    docs, held = table(spark, folder, "documents"), is_held_out("doc_id", 4, 2)
    found = language.identify(docs, language.learn(docs, ~held))
    return found.select("doc_id", held.alias("held_out"), "lang_pred", "score")


def op8_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    held = is_held_out("doc_id", 5, 0)
    model = toxicity.learn(docs, labels, ~held)
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op9_warc(spark: SparkSession, folder: str) -> DataFrame:
    archive = Stage(spark, "op9").folder
    warc.write_archive(table(spark, folder, "pages"), archive)
    back = warc.parsed(warc.read_archive(spark, archive))
    return back.select(
        F.col("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("long").alias("refers_to")
    )


def op10_minhash(spark: SparkSession, folder: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, folder, "documents"), shingle_words=4, percent=80)


def op11_neural(spark: SparkSession, folder: str) -> DataFrame:
    docs, held, stage = table(spark, folder, "documents"), is_held_out("doc_id", 7, 2), Stage(spark, "op11")
    model, counts = neural.learn(docs, ~held, stage)
    found = neural.score(docs, model, counts, stage)
    return found.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op12_spelling(spark: SparkSession, folder: str) -> DataFrame:
    return spelling.variants(table(spark, folder, "documents"))


def op13_collocations(spark: SparkSession, folder: str) -> DataFrame:
    return collocations.collocations(table(spark, folder, "documents"))


QUERIES = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_license_scan": op2_license_scan,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_sentencepiece": op4_sentencepiece,
    "op5_decontamination": op5_decontamination,
    "op6_quality": op6_quality,
    "op7_language": op7_language,
    "op8_toxicity": op8_toxicity,
    "op9_warc": op9_warc,
    "op10_minhash": op10_minhash,
    "op11_neural": op11_neural,
    "op12_spelling": op12_spelling,
    "op13_collocations": op13_collocations,
}

_NORMAL = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE = {
    "op3_exact_dedup": f"""
        WITH n AS (SELECT doc_id, {_NORMAL} AS body FROM documents),
        g AS (SELECT doc_id, body, max(doc_id) OVER (PARTITION BY body) AS keep_id, count(*) OVER (PARTITION BY body) AS group_size FROM n)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(body) AS text_sha256 FROM g
    """,
    "op10_minhash": f"""
        WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_NORMAL}, '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
        s AS (SELECT DISTINCT doc_id, array_to_string(list_slice(words, pos, pos + 3), ' ') AS shingle
              FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 3, 1) + 1)) AS pos FROM w WHERE len(words) > 0)),
        n AS (SELECT doc_id, count(*) AS size FROM s GROUP BY doc_id),
        pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common
                  FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
        links AS (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b
                  WHERE 100 * common >= 80 * (x.size + y.size - common)),
        reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
        least AS (SELECT a AS doc_id, min(b) AS other FROM reach GROUP BY a)
        SELECT w.doc_id, coalesce(n.size, 0) AS n_shingles, least(w.doc_id, coalesce(other, w.doc_id)) AS component_id,
               w.doc_id = least(w.doc_id, coalesce(other, w.doc_id)) AS kept
        FROM w LEFT JOIN n USING (doc_id) LEFT JOIN least USING (doc_id)
    """,
    "op12_spelling": f"""
        WITH RECURSIVE bits AS (SELECT i, list_reduce([i] || range(8), lambda c, _: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS entry FROM range(256) t(i)),
        sums AS (SELECT list(entry ORDER BY i) AS entries FROM bits),
        runs AS (SELECT coalesce(doc_id::VARCHAR, '') || ':' || run AS named, run, count(*) AS times
                 FROM (SELECT doc_id, unnest(regexp_extract_all({_NORMAL}, '[A-Za-z\u00C0-\u00FF]+')) AS run FROM documents) GROUP BY named, run),
        octets AS (SELECT run, times, list_transform(regexp_extract_all(hex(encode(named)), '..'), lambda x: ('0x' || x)::BIGINT) AS own FROM runs),
        marked AS (SELECT run, times, xor(list_reduce([4294967295] || own, lambda c, b: xor(entries[(xor(c, b) & 255) + 1], c >> 8)), 4294967295) AS mark FROM octets, sums),
        w AS (SELECT CASE WHEN mark % 97 = 0 THEN substr(run, 1, (mark % length(run))::BIGINT) || substr(run, (mark % length(run) + 2)::BIGINT) ELSE run END AS word, sum(times)::BIGINT AS n
              FROM marked GROUP BY word HAVING length(word) >= 5 AND n >= 3),
        holes AS (SELECT word, n, length(word) AS size, pos, substr(word, 1, pos - 1) || substr(word, pos + 1) AS rest
                  FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS pos FROM w)),
        near AS (SELECT a.word AS word, a.n AS n, b.word AS other, b.n AS m FROM holes a JOIN holes b ON a.rest = b.rest AND a.pos = b.pos AND a.size = b.size AND a.word <> b.word
                 UNION SELECT a.word, a.n, b.word, b.n FROM holes a JOIN w b ON a.rest = b.word
                 UNION SELECT b.word, b.n, a.word, a.n FROM holes a JOIN w b ON a.rest = b.word),
        best AS (SELECT word, any_value(n) AS n, count(*) AS n_near, arg_min(other, (-m, other)) AS other, max(m) AS m FROM near GROUP BY word),
        forms AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 2 * w.n THEN other END AS form, CASE WHEN m >= 2 * w.n THEN m END AS form_n FROM w LEFT JOIN best USING (word)),
        walk AS (SELECT word, form AS root FROM forms WHERE form IS NOT NULL UNION ALL SELECT walk.word, forms.form FROM walk JOIN forms ON forms.word = walk.root WHERE forms.form IS NOT NULL),
        ends AS (SELECT walk.word, walk.root FROM walk JOIN forms ON forms.word = walk.root WHERE forms.form IS NULL)
        SELECT word, form, coalesce(root, word) AS root, n, n_near, form_n FROM forms LEFT JOIN ends USING (word)
    """,
    "op13_collocations": f"""
        WITH pieces AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS words
                        FROM (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({_NORMAL}, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents)),
        places AS (SELECT lang, words, unnest(range(1, len(words) + 1)) AS pos FROM pieces),
        f1 AS (SELECT lang, words[pos] AS x, count(*) AS f FROM places GROUP BY ALL),
        f2 AS (SELECT lang, words[pos] AS x, words[pos + 1] AS y, count(*) AS f FROM places WHERE pos < len(words) GROUP BY ALL HAVING f >= 10),
        f3 AS (SELECT lang, words[pos] AS x, words[pos + 1] AS y, words[pos + 2] AS z, count(*) AS f FROM places WHERE pos + 1 < len(words) GROUP BY ALL HAVING f >= 10),
        totals AS (SELECT lang, sum(f)::BIGINT AS n FROM f1 GROUP BY lang),
        longer AS (SELECT lang, x, y, max(f) AS m FROM (SELECT lang, x, y, f FROM f3 UNION ALL SELECT lang, y, z, f FROM f3) GROUP BY lang, x, y),
        cuts AS (SELECT p.lang, p.x || ' ' || p.y AS phrase, 1 AS k, p.f AS a, u.f AS l, v.f AS r
                 FROM f2 p JOIN f1 u ON u.lang = p.lang AND u.x = p.x JOIN f1 v ON v.lang = p.lang AND v.x = p.y
                 LEFT JOIN longer g ON g.lang = p.lang AND g.x = p.x AND g.y = p.y WHERE g.m IS NULL OR 100 * g.m < 50 * p.f
                 UNION ALL SELECT t.lang, t.x || ' ' || t.y || ' ' || t.z, 1, t.f, u.f, v.f
                 FROM f3 t JOIN f1 u ON u.lang = t.lang AND u.x = t.x JOIN f2 v ON v.lang = t.lang AND v.x = t.y AND v.y = t.z
                 UNION ALL SELECT t.lang, t.x || ' ' || t.y || ' ' || t.z, 2, t.f, u.f, v.f
                 FROM f3 t JOIN f2 u ON u.lang = t.lang AND u.x = t.x AND u.y = t.y JOIN f1 v ON v.lang = t.lang AND v.x = t.z),
        scored AS (SELECT *, (1000000::HUGEINT * a * a // (l::HUGEINT * r))::BIGINT AS score FROM cuts),
        lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1)
        SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
        FROM lowest JOIN totals USING (lang) QUALIFY rank <= 2000
    """,
    "op9_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
        d AS (SELECT page_id, strlen(body) AS payload_bytes, sha256(body) AS payload_digest FROM p),
        f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM d)
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN first_id END AS refers_to
        FROM f
    """,
}
