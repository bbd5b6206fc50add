"""The queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import compression, decontam, langid, lines, media, minhash, packing, pii, resample, suffix, trie, urls
from .textcore import fold

#: Settings of both were chosen by cross-validation among the rows outside the held-out folds, and then frozen.
QUALITY = compression.Difference()
TOXICITY = compression.Thresholds()
THRESHOLD = 0.3


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents, dealt over all cores if they come in fewer pieces than there are cores; larger tables are not moved."""
    docs, cores = table(spark, sf_dir, "documents"), spark.sparkContext.defaultParallelism
    return docs.repartition(cores) if docs.rdd.getNumPartitions() < cores else docs


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir))


def op2_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))


def _classified(spark: SparkSession, sf_dir: str, label: str, modulus: int, held: int, recipe: compression.Recipe) -> DataFrame:
    """doc_id, held_out, score, predicted for every document. A null doc_id belongs to no fold: its held_out is null."""
    docs = documents(spark, sf_dir)
    model = compression.fit_labelled(docs, table(spark, sf_dir, "labels"), label, modulus, held, recipe)
    scored = compression.classify(docs, model, ["doc_id"])
    return scored.select("doc_id", (fold("doc_id", modulus) == held).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _classified(spark, sf_dir, "quality", 5, 0, QUALITY)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _classified(spark, sf_dir, "toxic", 4, 2, TOXICITY)


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))


def op6_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.quality_rules(documents(spark, sf_dir)).drop("repeated")


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(documents(spark, sf_dir))


def op8_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every text, the removed spans as start-end in ascending order (code points of the whole text), and their length."""
    left = lines.dedup_lines(documents(spark, sf_dir))
    spans = F.array_join(F.transform("removed", lambda s: F.concat_ws("-", s["start"], s["end"])), ",")
    return left.select("doc_id", "text", spans.alias("removed"), F.aggregate("removed", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"]).alias("n_removed"))


def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(documents(spark, sf_dir))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out (null for a null doc_id), lang_pred, score, spans as lang:first word-end word for every document."""
    docs = documents(spark, sf_dir)
    model = langid.fit(docs, 4, 2)
    found = langid.identify(docs, model)
    spans = F.array_join(F.transform("spans", lambda s: F.concat(s["lang"], F.lit(":"), s["start"], F.lit("-"), s["end"])), ",")
    return found.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score", spans.alias("spans"))


def rebuilt(convs: DataFrame) -> DataFrame:
    """conv_id, turns: of each conversation c the first h turns of conversation c - c % 5, then its own after its first h."""
    none = F.expr(f"CAST(array() AS {trie.TURNS})")
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 9).cast("int")
    heads = convs.where("conv_id % 5 = 0").select(F.col("conv_id").alias("base"), F.slice("turns", 1, 8).alias("head"))
    both = convs.withColumn("base", F.expr("conv_id - conv_id % 5")).join(heads, "base", "left")
    own = F.slice("turns", h + 1, F.greatest(F.size("turns") - h, F.lit(0)))
    return both.select("conv_id", F.concat(F.slice(F.coalesce("head", none), F.lit(1), h), own).alias("turns"))


def op11_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.nodes(rebuilt(trie.encoded(table(spark, sf_dir, "conversations"))))


def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resample(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))


def op13_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The size of a payload is that of the image in its header; digests, checksum and feature come from the bytes read back."""
    media_rows = media.media_columns(documents(spark, sf_dir))
    size = F.col("width") * F.col("height")
    return media_rows.select("doc_id", "n_bytes", size.alias("payload_bytes"), "payload_sha256", "tail_crc32", F.col("length").alias("media_bytes"), "media_sha256", "feature", "width", "height", "bit_depth")


QUERIES = {
    f.__name__: f
    for f in (op1_packing, op2_urls, op3_quality, op4_toxicity, op5_decontamination, op6_suffix, op7_pii, op8_lines, op9_minhash, op10_language, op11_trie, op12_resampling, op13_media)
}

# DuckDB twins

#: crc32 of a list of bytes: eight shifts a byte.
_CRC = "xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, flatten([[b, -1, -1, -1, -1, -1, -1, -1, -1] for b in {}])), lambda c, v: CASE WHEN v >= 0 THEN xor(c, v) ELSE xor(c >> 1, 3988292384 * (c & 1)) END))"
#: the same by a table in the column crc.
_CRC_BY_TABLE = "xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, {}), lambda c, v: xor(c >> 8, crc[(xor(c, v) & 255) + 1])))"
_BYTES = "[('0x' || h)::BIGINT for h in regexp_extract_all(hex({}), '..')]"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = "SELECT *, regexp_extract_all(" + _LOWER + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM {}"
_NGRAMS = "flatten([list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i:i + n - 1], ' ')) for n in [1, 2, 3]])"

#: DuckDB twins of the queries that SQL can express on whole tables.
ORACLE_SQL: dict[str, str] = {
    "op8_lines": r"""
        WITH cut AS (
            SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w, regexp_extract_all(text, '[\x20\x09-\x0D]+') AS g, regexp_matches(text, '^[\x20\x09-\x0D]')::INT AS lead FROM documents),
        words AS (
            SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i, len(w) AS n, unnest(list_transform(range(1, len(w) + 1), lambda i: coalesce(g[i + lead], ''))) AS gap, CASE WHEN lead = 1 THEN length(g[1]) ELSE 0 END AS lead FROM cut),
        placed AS (
            SELECT *, contains(gap, chr(10)) OR i = n AS line_end, length(gap) - length(replace(gap, chr(10), '')) > 1 OR i = n AS paragraph_end, regexp_matches(word, '[.!?,;:]$') OR contains(gap, chr(10)) AS last,
                lead + coalesce(sum(length(word) + length(gap)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM words),
        marked AS (
            SELECT *, start + length(word) AS finish, start + length(word) + length(gap) AS after, i = 1 OR lag(last) OVER by_doc AS first, i = 1 OR lag(line_end) OVER by_doc AS line_first, i = 1 OR lag(paragraph_end) OVER by_doc AS paragraph_first FROM placed WINDOW by_doc AS (PARTITION BY doc_id ORDER BY i)),
        whole AS (
            SELECT doc_id, min(i) AS i, min(start) AS start, max(i) AS j, max(finish) AS finish FROM (
                SELECT *, unnest([line, -paragraph]) AS run FROM (SELECT *, count(*) FILTER (line_first) OVER (PARTITION BY doc_id ORDER BY i) AS line, count(*) FILTER (paragraph_first) OVER (PARTITION BY doc_id ORDER BY i) AS paragraph FROM marked) AS l) AS r GROUP BY doc_id, run),
        spans AS (
            SELECT doc_id, i, i + 24 AS j, start FROM marked WHERE first AND i + 24 <= n UNION SELECT doc_id, i, j, start FROM whole WHERE j - i >= 24 OR finish - start >= 250),
        units AS (
            SELECT s.doc_id, s.start, l.after AS "end", translate(array_to_string(c.w[s.i:s.j], ' '), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS unit FROM spans AS s JOIN marked AS l ON l.doc_id = s.doc_id AND l.i = s.j JOIN cut AS c ON c.doc_id = s.doc_id),
        later AS (
            SELECT DISTINCT doc_id, start, "end" FROM (SELECT *, min({'d': doc_id, 's': start}) OVER (PARTITION BY unit) AS first FROM units) AS u WHERE doc_id <> first.d OR start <> first.s),
        islands AS (
            SELECT *, count(*) FILTER (fresh) OVER (PARTITION BY doc_id ORDER BY start, "end") AS island FROM (SELECT *, coalesce(start > max("end") OVER (PARTITION BY doc_id ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS fresh FROM later) AS x),
        gone AS (SELECT doc_id, min(start)::INT AS start, max("end")::INT AS "end" FROM islands GROUP BY doc_id, island),
        lists AS (SELECT doc_id, list(start ORDER BY start) AS a, list("end" ORDER BY start) AS b FROM gone GROUP BY doc_id)
        SELECT d.doc_id, CASE WHEN a IS NULL THEN text ELSE array_to_string(list_transform(range(1, len(a) + 2), lambda k: substring(text, coalesce(b[k - 1], 0) + 1, coalesce(a[k], length(text)) - coalesce(b[k - 1], 0))), '') END AS text,
            coalesce(array_to_string(list_transform(range(1, len(a) + 1), lambda k: a[k] || '-' || b[k]), ','), '') AS removed, coalesce(list_sum(b) - list_sum(a), 0)::BIGINT AS n_removed
        FROM documents AS d LEFT JOIN lists AS l ON l.doc_id = d.doc_id""",
    "op11_trie": f"""
        WITH convs AS (
            SELECT conv_id::BIGINT AS c, list({{'r': coalesce(role, ''), 't': coalesce(text, '')}} ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS own FROM conversations WHERE conv_id IS NOT NULL GROUP BY 1),
        heads AS (SELECT *, {_CRC.format(_BYTES.format('c::VARCHAR'))} % 9 AS h FROM convs),
        rebuilt AS (SELECT a.c, coalesce(b.own[1:a.h], []) || a.own[a.h + 1:] AS seq FROM heads AS a LEFT JOIN convs AS b ON b.c = a.c - a.c % 5),
        steps AS (SELECT c, d, seq[1:d] AS prefix, seq[d].t AS t, d = len(seq) AS last FROM (SELECT c, seq, unnest(range(len(seq) + 1)) AS d FROM rebuilt) AS u),
        nodes AS (
            SELECT d, prefix, min(c) AS conv_id, count(*) AS n, (count(*) - 1) * coalesce(strlen(any_value(t)), 0) AS saved, sha256(coalesce(string_agg(CASE WHEN last THEN c::VARCHAR END, ',' ORDER BY c), '')) AS ends FROM steps GROUP BY d, prefix),
        places AS (SELECT s.c, s.d, n.conv_id, n.n, n.saved, n.ends FROM steps AS s JOIN nodes AS n ON n.d = s.d AND n.prefix = s.prefix),
        linked AS (
            SELECT a.conv_id, a.d, a.n, a.saved, a.ends, min(p.conv_id) AS parent FROM (SELECT DISTINCT conv_id, d, n, saved, ends FROM places) AS a LEFT JOIN places AS p ON p.c = a.conv_id AND p.d = a.d - 1 GROUP BY ALL),
        kids AS (SELECT parent AS conv_id, d - 1 AS d, count(*) AS n_children FROM linked WHERE d > 0 GROUP BY ALL),
        counted AS (SELECT l.*, coalesce(n_children, 0) AS n_children FROM linked AS l LEFT JOIN kids AS k ON k.conv_id = l.conv_id AND k.d = l.d),
        below AS (
            SELECT p.conv_id, p.d, sum(x.saved)::BIGINT AS saved, count(*) FILTER (x.n_children = 0) AS leaves FROM counted AS x JOIN places AS p ON p.c = x.conv_id AND p.d <= x.d GROUP BY ALL)
        SELECT c.conv_id, c.d::BIGINT AS depth, c.parent AS parent_conv_id, c.n AS n_convs, c.n_children, b.leaves AS n_leaves, b.saved AS saved_tokens, c.ends AS ends_sha256 FROM counted AS c JOIN below AS b ON b.conv_id = c.conv_id AND b.d = c.d""",
    "op12_resampling": f"""
        WITH docs AS (SELECT doc_id, len(w) AS n, {_NGRAMS} AS f FROM ({_WORDS.format('documents')}) AS d), bench AS (SELECT {_NGRAMS} AS f FROM ({_WORDS.format('benchmark')}) AS b),
        uses AS (SELECT f, sum(s) AS s, sum(t) AS t FROM (SELECT unnest(f) AS f, 1 AS s, 0 AS t FROM docs UNION ALL SELECT unnest(f), 0, 1 FROM bench) AS u GROUP BY f),
        crc AS (SELECT list(c ORDER BY i) AS crc FROM (SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, v: xor(c >> 1, 3988292384 * (c & 1))) AS c FROM range(256) AS r(i)) AS x),
        hashed AS (SELECT f, s, t, {_CRC_BY_TABLE.format(_BYTES.format('f'))} % 10000 AS bucket FROM uses, crc),
        sums AS (SELECT bucket, sum(s) AS s, sum(t) AS t FROM hashed GROUP BY bucket),
        gains AS (SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * (sum(s) OVER () + 10000)::DOUBLE / ((s + 1)::DOUBLE * (sum(t) OVER () + 10000)::DOUBLE)))::BIGINT AS gain FROM sums),
        weights AS (SELECT doc_id, sum(gain)::BIGINT AS weight FROM (SELECT doc_id, unnest(f) AS f FROM docs) AS d JOIN hashed USING (f) JOIN gains USING (bucket) GROUP BY doc_id),
        scored AS (
            SELECT doc_id, n, len(f) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || left(sha256('42:' || doc_id), 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM docs LEFT JOIN weights USING (doc_id)),
        placed AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n FROM scored WHERE n >= 20)
        SELECT s.doc_id, n_features, weight, score, CASE WHEN rank <= 5 * p.n // 100 THEN rank END AS rank FROM scored AS s LEFT JOIN placed AS p ON p.doc_id = s.doc_id""",
}
