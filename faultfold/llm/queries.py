"""Registered queries of the package: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultfold.llm import (
    alignment,
    bpe,
    chat,
    html_wrapper,
    licences,
    packing,
    pii,
    quality_classifier,
    quality_rules,
    ranked,
    repeats,
    topk,
)
from faultfold.llm.common import table
from faultfold.llm.near_dedup import near_duplicates


def vocabulary(name: str) -> str:
    """Place of a public tokenizer's file; the operators take any path."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return licences.scan(documents, licences.fit(documents))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and digest are of the rules' spans, ``spans`` and ``n_added`` of the tagger's too."""
    documents = table(spark, sf_dir, "documents")
    rows = pii.find(documents, pii.fit(documents))

    def count(kind, column="base"):
        return F.regexp_count(column, F.lit(f"{kind}:")).cast("long")

    return rows.select(
        "doc_id",
        *[count(kind).alias(f"n_{kind}") for kind in pii.KINDS],
        F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"),
        "spans",
        (count("[a-z]+", "spans") - count("[a-z]+")).alias("n_added"),
    )


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality_rules.ledger(table(spark, sf_dir, "documents"))
    base = quality_rules.failed(quality_rules.BASE)
    return rows.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        base.alias("base_failed"),
        (~base & ~quality_rules.failed(quality_rules.CURRENT)).alias("kept"),
        "failure_bits",
    )


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), percent=85)


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = bpe.encode(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), decoded=True)
    listed = F.concat_ws(",", F.col("ids").cast("array<string>"))
    return rows.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(listed.cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op6_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    model = quality_classifier.fit(documents, table(spark, sf_dir, "labels"))
    return quality_classifier.score_documents(documents, model)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    planted = spark.createDataFrame(
        [(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string"
    )
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").union(planted)
    return chat.digests(chat.format_conversations(rows))


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_wrapper.extract_pages(table(spark, sf_dir, "pages"))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = alignment.align(
        table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model")
    )
    digest = F.when(F.col("n_a") > 0, F.sha2(F.col("groups").cast("binary"), 256)).otherwise("")
    counted = alignment.with_counts(rows.withColumn("groups_sha256", digest).drop("groups"))
    return counted.select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"
    )


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = repeats.remove_repeats(table(spark, sf_dir, "documents"))
    digest = F.sha2(F.col("text").cast("binary"), 256)
    return rows.select("doc_id", "n_words", "n_removed", digest.alias("kept_sha256"))


QUERIES = {
    "op1_licence_scan": op1_licence_scan,
    "op2_pii": op2_pii,
    "op3_quality_rules": op3_quality_rules,
    "op4_near_dedup": op4_near_dedup,
    "op5_bpe": op5_bpe,
    "op6_top_k": op6_top_k,
    "op7_quality_classifier": op7_quality_classifier,
    "op8_packing": op8_packing,
    "op9_chat_format": op9_chat_format,
    "op10_html_text": op10_html_text,
    "op11_token_alignment": op11_token_alignment,
    "op12_ranked_search": op12_ranked_search,
    "op13_repeated_passages": op13_repeated_passages,
}

_TERMS = """unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[0-9a-z\\x{80}-\\x{10FFFF}]+'))"""

ORACLE: dict[str, str] = {
    "op12_ranked_search": f"""
with occurrences as (select doc_id, {_TERMS} as term from documents),
tf as (select doc_id, term, count(*) as tf from occurrences group by all),
lengths as (select doc_id, count(*) as n from occurrences group by all),
total as (select count(*) as docs, sum(n)::bigint as terms from lengths),
m as (select doc_id, 25 + (75 * n * docs) // terms as m from lengths, total),
weight as (select term, floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1)))::bigint as w
    from tf, total group by term, docs),
asked as (select item_id, {_TERMS} as term from benchmark),
score as (select item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::bigint as score
    from asked join tf using (term) join weight using (term) join m using (doc_id) group by all)
select item_id, rank::int as rank, doc_id, score from (
    select *, row_number() over (partition by item_id order by score desc, doc_id) as rank
    from score where score > 0)
where rank <= 10""",
    "op13_repeated_passages": """
with split as (select doc_id, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') as words from documents),
texts as (select doc_id, coalesce(words, []) as words from split),
starts as (select doc_id, words, unnest(range(1, len(words) - 33)) as place from texts),
windows as (select doc_id, place, words[place:place + 34] as w from starts),
repeated as (select doc_id, place from windows
    where w in (select w from windows group by w having count(*) > 1)),
covered as (select distinct doc_id, place + k as place from repeated, (select unnest(range(35)) as k)),
listed as (select doc_id, unnest(words) as word, unnest(range(1, len(words) + 1)) as place from texts),
kept as (select doc_id, count(*) as n_kept, string_agg(word, ' ' order by place) as text
    from listed anti join covered using (doc_id, place) group by all)
select doc_id, len(words)::bigint as n_words, (len(words) - coalesce(n_kept, 0))::bigint as n_removed,
    sha256(coalesce(text, '')) as kept_sha256
from texts left join kept using (doc_id)""",
}
