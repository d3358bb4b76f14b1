"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, let, table
from .decontam import find_contamination, items_digest, run_words
from .lines import dedup_lines
from .mixing import mix_sources
from .near import near_duplicates
from .periodic import find_runs
from .quality import quality_verdicts
from .resampling import resample
from .secrets import scan_secrets, span_digest
from .substrings import remove_passages
from .suffix import remove_repeats
from .tokens import token_counts
from .toxicity import learn_lexicon, score_toxicity
from .urls import filter_urls

# The url rules (verdict, host, path prefix) and the host labels of the listed urls.
URL_RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]
LISTED_HOST = "cheap|pills|casino|poker|loans"


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix_sources(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_verdicts(table(spark, sf_dir, "documents"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), short=True)
    return found.select("doc_id", "n_lines", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    n_hit = run_words()
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        items_digest().alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", span_digest("base_spans").alias("base_sha256"), F.array_join("spans", ",").alias("spans"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return score_toxicity(docs, learn_lexicon(docs, table(spark, sf_dir, "labels")))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The list holds the urls that the table itself has on hosts of advertisers."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return filter_urls(pages, pages.where(F.col("url").rlike(f"://[^/?#]*({LISTED_HOST})")).select("url"), URL_RULES)


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s[1] - s[0])
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def _planted(docs: DataFrame) -> DataFrame:
    """`docs` with the words of every tenth id, from some place on, repeating the words found there; as its contract has it. Rows without id stay."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    text = F.struct(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)).alias("w"), F.floor(h / 10).alias("g"))

    def start(x):
        n = F.coalesce(F.size(x["w"]), F.lit(0)).cast("long")
        a = F.pmod(x["g"], F.greatest(n, F.lit(1)))
        return F.struct(x["w"].alias("w"), n.alias("n"), a.alias("a"), (1 + F.floor((n - a) / (3 + F.pmod(x["g"], F.lit(8))))).alias("p"))

    def repeated(y):
        place = F.sequence(F.lit(0).cast("long"), y["n"] - 1)
        words = F.transform(place, lambda i: F.element_at(y["w"], F.when(i < y["a"], i).otherwise(y["a"] + F.pmod(i - y["a"], y["p"])).cast("int") + 1))
        return F.when(y["n"] > 0, F.array_join(words, " ")).otherwise("")

    planted = let(text, lambda x: let(start(x), repeated))
    return docs.select("doc_id", F.when(F.pmod(h, F.lit(10)) == 0, planted).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_runs(_planted(table(spark, sf_dir, "documents").select("doc_id", "text")))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("s"), (-r["period"]).alias("p"))))
    listed = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    found = found.withColumn("best", best).withColumn("listed", F.concat(listed, F.when(F.size("runs") > 0, "\n").otherwise("")))
    length, period = F.col("best.length"), -F.col("best.p")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.s")).alias("start"), length.alias("length"), period.alias("period"),
        F.floor(1000 * length / period).alias("exponent_milli"), F.sha2("listed", 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = resample(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"), max_n=1)
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


def op13_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_passages(table(spark, sf_dir, "documents").select("doc_id", "text"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["stop"] - s["first"])
    return found.select("doc_id", "n_words", removed.alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256"))


def queries() -> dict:
    return {f.__name__: f for f in (op1_mixing, op2_token_counts, op3_quality_rules, op4_line_dedup, op5_decontamination, op6_minhash, op7_secret_scan, op8_url_filter, op9_toxicity, op10_suffix_dedup, op11_periodic_runs, op12_importance_resampling, op13_substring_dedup)}


def oracle_sql() -> dict[str, str]:
    from .sql import ORACLES

    return ORACLES
