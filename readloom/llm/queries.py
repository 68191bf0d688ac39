"""The queries of this subpackage, one for each operator, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_bpe() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed with weights 3, 1, 2 to 150 % of all words, no source above twice its size."""
    from . import mixing

    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixing.taken(mixing.mix(docs)).select("doc_id", "source", F.col("size"), "source_size", "target", "taken")


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text encoded and decoded with the word vocabulary."""
    from . import bpe

    return bpe.digests(bpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), word_bpe()))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text scored by a lexicon learned from the labels outside the held-out third."""
    from . import toxicity

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    lexicon = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, lexicon, ["doc_id"])
    return scored.select("doc_id", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False)).alias("held_out"), "score", "predicted")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and the smallest doc_id that links of four bits reach."""
    from . import simhash
    from .common import settle

    prints = settle(simhash.with_fingerprints(table(spark, sf_dir, "documents").select("doc_id", "text")))
    grouped = simhash.groups(prints)
    return grouped.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts of all documents and the verdict of the n-gram ratio."""
    from . import quality

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels")))
    return scored.drop("text")


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and conversation -7, formatted and read back."""
    from . import chat

    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "\\### Assistant: </turn> ok"
    probe = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], turns.schema)
    return chat.formatted_digests(turns.unionByName(probe))


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of all pages."""
    from . import extract

    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extract.extract(pages, extract.fit(pages)).withColumn("n_chars", F.length("text").cast("long"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All urls judged by rules and by the link graph of their hosts."""
    from . import urls

    return urls.filter_urls(table(spark, sf_dir, "pages"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written to WARC archives and read back."""
    from . import warc

    chunks = warc.read_archives(warc.write_archives(table(spark, sf_dir, "pages")), payloads=False)
    ended = chunks.filter("last")
    return ended.select("page_id", F.col("bytes_so_far").alias("payload_bytes"), F.col("digest_so_far").alias("payload_digest"), "record_type", "refers_to")


def op9_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest of every vector whose id 50 divides."""
    from . import neighbours

    return neighbours.nearest(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def with_periodic_tails(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) where a tenth of the ids, by a hash h of the decimal id, get a tail of repeated words.

    With n words, g = h / 10 and h % 10 = 0, word a = g % n and those after it become the first p of them over and over, p = 1 + (n - a) / (3 + g % 8).
    Null ids, and texts without words, stay.
    """
    from .common import WORD

    def let(value, use):  # value is computed once
        return F.transform(F.array(value), use)[0]

    h = F.crc32(F.col("doc_id").cast("string"))
    g = F.floor(h / 10).cast("long")

    def tailed(w, a, p):
        rest = F.size(w) - a
        head, block, end = (F.array_join(F.slice(w, x, k), " ") for x, k in ((F.lit(1), a), (a + 1, p), (a + 1, rest % p)))
        return F.concat_ws(" ", head, F.repeat(F.concat(block, F.lit(" ")), F.floor(rest / p).cast("int")), end)

    def changed(w):
        n = F.size(w)
        a = (g % n).cast("int")
        p = F.floor(F.lit(1) + F.floor((n - a) / (3 + g % 8))).cast("int")
        return F.when(n == 0, F.lit("")).otherwise(let(F.struct(a.alias("a"), p.alias("p")), lambda x: tailed(w, x["a"], x["p"])))

    words = F.regexp_extract_all("text", F.lit(WORD), F.lit(0))
    return docs.withColumn("text", F.when((h % 10 == 0) & F.col("text").isNotNull(), let(words, changed)).otherwise(F.col("text")))


def op11_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs in the words of all documents, a tenth of them with repeated tails, and what is left without repeats."""
    from . import runs

    docs = with_periodic_tails(table(spark, sf_dir, "documents").select("doc_id", "text"))
    found = runs.find_runs(docs)
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"], (-r["start"]).alias("before"), (-r["period"]).alias("faster"))))
    digests = [F.sha2(F.concat_ws("", lines), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256")]
    rows = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), *digests)
    start, length, period = -F.col("best.before"), F.col("best.length"), -F.col("best.faster")
    return rows.select(
        "doc_id", "n_runs", start.alias("start"), length.alias("length"), period.alias("period"),
        F.expr("1000 * best.length div -best.faster").alias("exponent_milli"), "runs_sha256", "collapsed_sha256",
    )


def op12_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents that lie in a benchmark's ten-word windows, and the items they are from."""
    from . import decontam

    found = decontam.mark(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", "text"))
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])
    names = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    rows = found.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(names, 256).alias("items_sha256"))
    return rows.withColumn("contaminated", F.col("n_hit") > 0)


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2,000 best phrases of two and three words of each language."""
    from . import collocations

    return collocations.collocations(table(spark, sf_dir, "documents").select("lang", "text"))


QUERIES = {
    "op1_mix_sources": op1_mix_sources,
    "op2_bpe": op2_bpe,
    "op3_chat_format": op3_chat_format,
    "op4_html_text": op4_html_text,
    "op5_url_filter": op5_url_filter,
    "op6_warc": op6_warc,
    "op7_toxicity": op7_toxicity,
    "op8_simhash": op8_simhash,
    "op9_nearest": op9_nearest,
    "op10_quality_rules": op10_quality_rules,
    "op11_runs": op11_runs,
    "op12_decontaminate": op12_decontaminate,
    "op13_collocations": op13_collocations,
}
ORACLES: dict[str, str] = {
    "op3_chat_format": """
        WITH turns AS (
          SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
          UNION ALL SELECT -7, 0, 'user', '\\### Assistant: </turn> ok'
          UNION ALL SELECT -7, 1, 'assistant', '\\### Assistant: </turn> ok'
        ), said AS (
          SELECT *, length(replace(replace(replace(text, '\\', '\\\\'), '### ', '\\### '), '</turn>', '\\</turn>'))
                  + length(replace(replace(replace(replace(role, '\\', '\\\\'), '### ', '\\### '), '</turn>', '\\</turn>'), ':', '\\:'))
                  + length('### ' || ': ' || '</turn>' || chr(10)) AS formatted
          FROM turns
        )
        SELECT conv_id, count(*) AS n_turns,
               sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
               coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
               sum(formatted)::BIGINT AS formatted_chars
        FROM said GROUP BY conv_id
    """,
    "op6_warc": """
        WITH keyed AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
        hashed AS (
          SELECT page_id, strlen(body)::BIGINT AS payload_bytes, sha1(body) AS hex,
                 max(page_id) OVER (PARTITION BY sha1(body)) AS best
          FROM keyed
        ), digits AS (
          SELECT *, [instr('0123456789abcdef', substr(hex, k, 1)) - 1 FOR k IN range(1, 41)] AS n FROM hashed
        )
        SELECT page_id, payload_bytes,
               list_aggregate([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                 ((((n[(5 * k) // 4 + 1] * 16 + n[(5 * k) // 4 + 2]) >> (3 - (5 * k) % 4)) & 31) + 1)::BIGINT, 1) FOR k IN range(0, 32)], 'string_agg', '') AS payload_digest,
               CASE WHEN page_id = best THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id <> best THEN best END AS refers_to
        FROM digits
    """,
    "op12_decontaminate": r"""
        WITH folded AS (
          SELECT doc_id, NULL::BIGINT AS item_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low FROM documents
          UNION ALL
          SELECT NULL, item_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') FROM benchmark
        ), words AS (
          SELECT row_number() OVER () AS row, doc_id, item_id, regexp_extract_all(coalesce(low, ''), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM folded
        ), items AS (
          SELECT item_id, w, least(len(w), 10) AS size FROM words WHERE item_id IS NOT NULL AND len(w) > 0
        ), patterns AS (
          SELECT DISTINCT item_id, size, list_aggregate(w[k:k + size - 1], 'string_agg', ' ') AS phrase
          FROM (SELECT item_id, w, size, unnest(range(1, len(w) - size + 2)) AS k FROM items)
        ), docs AS (
          SELECT * FROM words WHERE item_id IS NULL
        ), places AS (
          SELECT row, k, size, list_aggregate(w[k:k + size - 1], 'string_agg', ' ') AS phrase
          FROM (SELECT row, w, size, unnest(range(1, len(w) - size + 2)) AS k FROM docs CROSS JOIN (SELECT DISTINCT size FROM patterns))
        ), hits AS (
          SELECT row, k, places.size, item_id FROM places JOIN patterns ON places.size = patterns.size AND places.phrase = patterns.phrase
        ), hit_words AS (
          SELECT row, count(DISTINCT place) AS n_hit FROM (SELECT row, unnest(range(k, k + size)) AS place FROM (SELECT DISTINCT row, k, size FROM hits)) GROUP BY row
        ), named AS (
          SELECT row, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT row, item_id::VARCHAR AS id FROM hits) GROUP BY row
        )
        SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
               sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM docs LEFT JOIN hit_words USING (row) LEFT JOIN named USING (row)
    """,
    "op13_collocations": r"""
        WITH pieces AS (
          SELECT coalesce(lang, 'und') AS lang,
                 unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\n\x0B\f\r]+')) AS piece
          FROM documents
        ), words AS (
          SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces
        ), grams AS (
          SELECT lang, size, list_aggregate(w[k:k + size - 1], 'string_agg', ' ') AS phrase
          FROM (SELECT lang, w, size, unnest(range(1, len(w) - size + 2)) AS k FROM words CROSS JOIN (VALUES (1), (2), (3)) AS sizes(size))
        ), counts AS (
          SELECT lang, size, phrase, count(*) AS a FROM grams GROUP BY ALL
        ), totals AS (
          SELECT lang, sum(a)::BIGINT AS n FROM counts WHERE size = 1 GROUP BY lang
        ), parts AS (
          SELECT lang, size, phrase, a, string_split(phrase, ' ') AS w FROM counts WHERE a >= 10
        ), cuts AS (
          SELECT lang, size, phrase, a, 1 AS cut, w[1] AS p, list_aggregate(w[2:], 'string_agg', ' ') AS q FROM parts WHERE size > 1
          UNION ALL
          SELECT lang, size, phrase, a, 2, w[1] || ' ' || w[2], w[3] FROM parts WHERE size = 3
        ), graded AS (
          SELECT cuts.*, f.a AS l, g.a AS r, ((1000000::HUGEINT * cuts.a * cuts.a) // (f.a::HUGEINT * g.a))::BIGINT AS score
          FROM cuts JOIN parts f ON f.lang = cuts.lang AND f.phrase = p JOIN parts g ON g.lang = cuts.lang AND g.phrase = q
        ), weakest AS (
          SELECT * FROM graded QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1
        ), held AS (
          SELECT lang, phrase, max(a) AS most FROM (
            SELECT lang, w[1] || ' ' || w[2] AS phrase, a FROM parts WHERE size = 3 UNION ALL SELECT lang, w[2] || ' ' || w[3], a FROM parts WHERE size = 3) GROUP BY ALL
        ), kept AS (
          SELECT weakest.* FROM weakest LEFT JOIN held USING (lang, phrase) WHERE most IS NULL OR 100 * most < 50 * a
        )
        SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
        FROM kept JOIN totals USING (lang) QUALIFY rank <= 2000
    """,
}
