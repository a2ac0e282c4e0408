"""Multiple-choice questions: two-layer validation with reject routing, scores, statistics, export and review."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions import text as X
from lectern.functions.vocab import ANSWERS, BLOOM, BLOOM_BY_DIFFICULTY, BLOOM_OF_RELATION, BLOOM_OF_TYPE, DIFFICULTY, MCQ_FIELDS

_s = lambda c: X.strip(F.coalesce(F.col(c), F.lit("")))


def mapped(c: str | Column, table: dict[str, str], default: str | None = None) -> Column:
    out = F.lit(default).cast("string")
    for k, v in table.items():
        out = F.when(X.col(c) == k, v).otherwise(out)
    return out


def difficulty_of(bloom: str | Column) -> Column:
    return mapped(bloom, {b: d for d, bs in BLOOM_BY_DIFFICULTY.items() for b in bs}, "medium")


def bloom_of_type(c: str | Column) -> Column:
    return mapped(c, BLOOM_OF_TYPE, "understand")


def bloom_of_relation(c: str | Column) -> Column:
    return mapped(c, BLOOM_OF_RELATION, "analyze")


def priority(prominence: str | Column, tier: str | Column) -> Column:
    """1 to 4 by prominence and tier; 5 for tier C."""
    primary = X.col(prominence) == "primary"
    return F.when(X.col(tier) == "A", F.when(primary, 1).otherwise(2)).when(X.col(tier) == "B", F.when(primary, 3).otherwise(4)).otherwise(5)


def tier_of(n: str | Column) -> Column:
    return F.when(X.col(n) >= 3, "A").when(X.col(n) >= 1, "B").otherwise("C")


def schema_reason() -> Column:
    """The first failing schema rule, or null."""
    missing = F.filter(F.array(*[F.when(F.col(f).isNull(), f) for f in sorted(MCQ_FIELDS)]), lambda x: x.isNotNull())
    answer, bloom, diff = F.upper(_s("answer")), F.lower(_s("bloom_level")), F.lower(_s("difficulty"))
    quoted = F.array_join(F.transform(missing, lambda x: F.concat(F.lit("'"), x, F.lit("'"))), ", ")
    return (
        F.when(F.size(missing) > 0, F.concat(F.lit("Missing fields: ["), quoted, F.lit("]")))
        .when(~answer.isin(*ANSWERS), F.concat(F.lit("Invalid answer: '"), answer, F.lit("' (must be A/B/C/D)")))
        .when(~bloom.isin(*BLOOM), F.concat(F.lit("Invalid bloom_level: '"), bloom, F.lit("'")))
        .when(~diff.isin(*DIFFICULTY), F.concat(F.lit("Invalid difficulty: '"), diff, F.lit("'")))
    )


def _quality_reasons() -> tuple[Column, Column]:
    """Reasons before and after the rule on duplicate questions, of rows that pass the schema and are normalized."""
    options = [X.collapse(F.lower(F.col(o))) for o in ANSWERS]
    n = F.length("question")
    before = F.when(n < 10, F.concat(F.lit("Question too short ("), n.cast("string"), F.lit(" chars)")))
    for o in ANSWERS:
        before = before.when(F.col(o) == "", f"Option {o} is empty")
    before = before.when(F.size(F.array_distinct(F.array(*options))) < 4, "Duplicate options").when(F.col("explanation") == "", "Explanation is empty")
    after = F.when(
        (F.col("difficulty") == "hard") & F.col("bloom_level").isin("remember", "understand"),
        F.concat(F.lit("Bloom/Difficulty mismatch: difficulty=hard but bloom="), F.col("bloom_level")),
    )
    return before, after


def validated(mcqs: DataFrame) -> DataFrame:
    """Adds (layer, reason, quality_score, bloom_mismatch): layer and reason are null for valid rows.

    A question is a duplicate if an earlier row of its document with the same normalized question is valid.
    """
    first = mcqs.withColumn("_schema", schema_reason())
    ok = F.col("_schema").isNull()
    plain = {f: F.when(ok, X.strip(F.col(f))).otherwise(F.col(f)) for f in MCQ_FIELDS}
    plain["answer"] = F.when(ok, F.upper(X.strip("answer"))).otherwise(F.col("answer"))
    for f in ("bloom_level", "difficulty"):
        plain[f] = F.when(ok, F.lower(X.strip(f))).otherwise(F.col(f))
    rows = first.withColumns(plain)
    before, after = _quality_reasons()
    rows = rows.withColumns({"_before": F.when(ok, before), "_after": F.when(ok, after), "_q": F.when(ok, X.collapse(F.lower("question")))})
    good = ok & F.col("_before").isNull() & F.col("_after").isNull()
    rows = rows.withColumn("_first", F.min(F.when(good, F.col("ord"))).over(Window.partitionBy("doc_id", "_q")))
    seen = F.coalesce(F.col("_first") < F.col("ord"), F.lit(False))
    quality = F.coalesce(F.col("_before"), F.when(seen, "Duplicate question"), F.col("_after"))
    options = [X.collapse(F.lower(F.col(o))) for o in ANSWERS]
    distinct = F.size(F.filter(F.array_distinct(F.array(*options)), lambda x: x != "")) == 4
    expected = F.lit(False)
    for d, bs in BLOOM_BY_DIFFICULTY.items():
        expected = expected | ((F.col("difficulty") == d) & F.col("bloom_level").isin(*bs))
    points = F.lit(1) + sum((x.cast("int") for x in (distinct, F.col("explanation") != "", expected, (F.col("_q") != "") & ~seen)), F.lit(0))
    return rows.withColumns(
        {
            "layer": F.when(~ok, "schema").when(quality.isNotNull(), "quality"),
            "reason": F.coalesce("_schema", quality),
            "quality_score": F.when(ok, F.round(points / 5.0, 2)),
            "bloom_mismatch": F.when(ok, ~expected),
        }
    ).drop("_schema", "_before", "_after", "_q", "_first")


def split_valid(checked: DataFrame) -> tuple[DataFrame, DataFrame]:
    return checked.where("layer is null"), checked.where("layer is not null")


def validation_stats(checked: DataFrame, by: str = "doc_id") -> DataFrame:
    """Pass rate, mismatch rate and mean score of each group; mismatches and scores over valid rows."""
    valid = F.col("layer").isNull()
    n, v = F.count(F.lit(1)), F.count_if(valid)
    bad = F.count_if(valid & F.col("bloom_mismatch"))
    return checked.groupBy(by).agg(
        n.alias("total_raw"),
        v.alias("valid"),
        (n - v).alias("rejected"),
        F.round(v / n * 100, 1).alias("pass_rate"),
        bad.alias("bloom_mismatch_count"),
        F.when(v > 0, F.round(bad / F.greatest(v, F.lit(1)) * 100, 1)).otherwise(0.0).alias("bloom_mismatch_rate"),
        F.coalesce(F.round(X.exact_mean(F.when(valid, F.col("quality_score"))), 3), F.lit(0.0)).alias("average_quality_score"),
    )


def distributions(checked: DataFrame) -> DataFrame:
    """Counts (what, value, n): Bloom level and difficulty of valid rows, reason (up to its colon) and layer of the others."""
    valid, rejected = split_valid(checked)
    parts = [
        valid.select(F.lit("bloom").alias("what"), F.col("bloom_level").alias("value")),
        valid.select(F.lit("difficulty").alias("what"), F.col("difficulty").alias("value")),
        rejected.select(F.lit("reason").alias("what"), F.substring_index("reason", ":", 1).alias("value")),
        rejected.select(F.lit("layer").alias("what"), F.col("layer").alias("value")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("what", "value").agg(F.count(F.lit(1)).alias("n"))


def prepared(mcqs: DataFrame, question_chars: int = 120, option_chars: int = 75) -> DataFrame:
    """For export: normalized answer, one-line texts cut to length. Adds error: what stands against export, or null."""
    rows = mcqs.withColumns(
        {"answer": F.upper(_s("answer")), "question": X.sanitize("question", question_chars), **{o: X.sanitize(o, option_chars) for o in ANSWERS}}
    )
    error = F.when(~F.col("answer").isin(*ANSWERS), F.concat(F.lit("invalid answer: "), F.col("answer")))
    for o in ANSWERS:
        error = error.when(F.col(o) == "", f"missing option {o}")
    return rows.withColumn("error", error.when(F.col("question") == "", "missing question"))


def strict(rows: DataFrame) -> DataFrame:
    """Raises at run time if a row has an error."""
    fine = F.when(F.col("error").isNull(), F.col("question")).otherwise(F.raise_error(F.concat(F.lit("cannot export: "), F.col("error"))))
    return rows.withColumn("question", fine.cast("string")).drop("error")


def kahoot(rows: DataFrame) -> DataFrame:
    return rows.select(
        *[c for c in ("doc_id", "ord") if c in rows.columns],
        F.col("question").alias("Question"), *[F.col(o).alias(f"Answer {k}") for k, o in enumerate(ANSWERS, 1)],
        F.lit(30).alias("Time Limit (sec)"), F.expr("instr('ABCD', answer)").alias("Correct Answer"),
    )


def correct_text() -> Column:
    out = F.lit("")
    for o in ANSWERS:
        out = F.when(F.col("answer") == o, F.col(o)).otherwise(out)
    return out


def quizizz(rows: DataFrame) -> DataFrame:
    return rows.select(
        *[c for c in ("doc_id", "ord") if c in rows.columns],
        F.col("question").alias("Question Text"), *[F.col(o).alias(f"Option {k}") for k, o in enumerate(ANSWERS, 1)],
        correct_text().alias("Correct Answer"), F.lit(30).alias("Time in seconds"), F.lit("").alias("Image Link"),
    )


def forms_payload(rows: DataFrame) -> DataFrame:
    """A form's create-item request for each question, as JSON; sending it is left to a client."""
    options = F.array(*[F.struct(F.col(o).alias("value")) for o in ANSWERS])
    item = F.struct(
        F.struct(
            F.struct(
                F.col("question").alias("title"),
                F.struct(
                    F.struct(
                        F.lit(True).alias("required"),
                        F.struct(F.lit(1).alias("pointValue"), F.struct(F.array(F.struct(correct_text().alias("value"))).alias("answers")).alias("correctAnswers")).alias("grading"),
                        F.struct(F.lit("RADIO").alias("type"), options.alias("options"), F.lit(False).alias("shuffle")).alias("choiceQuestion"),
                    ).alias("question")
                ).alias("questionItem"),
            ).alias("item"),
            F.struct((F.col("ord") - 1).alias("index")).alias("location"),
        ).alias("createItem")
    )
    return rows.select("doc_id", "ord", F.to_json(item).alias("request"))


def write_quizizz(rows: DataFrame, path: str) -> None:
    """CSV with a header, one byte-order mark at the head of each file."""
    out = quizizz(rows).drop("doc_id", "ord")
    out.withColumnRenamed("Question Text", "﻿Question Text").write.mode("overwrite").option("header", True).option("quote", '"').csv(path)


def rotated(accepted: DataFrame, offset: int = 0) -> DataFrame:
    """Give the accepted rows of a document (in order) the answers A, B, C, D in turn: swap option texts, and the two letters in explanations."""
    target = F.element_at(F.array(*[F.lit(a) for a in ANSWERS]), ((F.row_number().over(Window.partitionBy("doc_id").orderBy("ord")) - 1 + offset) % 4 + 1).cast("int"))
    rows = accepted.withColumns({"_t": target, "_o": F.col("answer")})
    both = {o: F.when(F.col("_t") == F.col("_o"), F.col(o)) for o in ANSWERS}
    at = lambda c: F.element_at(F.create_map(*[x for o in ANSWERS for x in (F.lit(o), F.col(o))]), c)
    new = {o: both[o].when(F.col("_t") == o, at(F.col("_o"))).when(F.col("_o") == o, at(F.col("_t"))).otherwise(F.col(o)) for o in ANSWERS}
    text = F.col("explanation")
    alone = lambda t, src, dst: F.regexp_replace(t, F.concat(F.lit("(?<![A-Za-z0-9])"), src, F.lit("(?![A-Za-z0-9])")), dst)
    swapped = alone(text, F.col("_o"), F.lit("__MCQ_LETTER_1__"))
    swapped = alone(swapped, F.col("_t"), F.lit("__MCQ_LETTER_2__"))
    swapped = F.replace(F.replace(swapped, F.lit("__MCQ_LETTER_1__"), F.col("_t")), F.lit("__MCQ_LETTER_2__"), F.col("_o"))
    new["explanation"] = F.when(F.col("_t") == F.col("_o"), text).otherwise(swapped)
    return rows.withColumns(new).withColumn("answer", F.col("_t")).drop("_t", "_o")


def item_ok() -> Column:
    """Question and four different non-blank options, answer among the letters."""
    own = [F.lower(_s(o)) for o in ANSWERS]
    return (_s("question") != "") & F.upper(_s("answer")).isin(*ANSWERS) & (F.size(F.filter(F.array_distinct(F.array(*own)), lambda x: x != "")) == 4)


def difficulty_gate(c: str | Column, difficulty: str) -> Column:
    """Which priorities a difficulty admits."""
    most = {"easy": 2, "medium": 5}.get(difficulty)
    return F.lit(True) if most is None else X.col(c) <= most


def reviewed(mcqs: DataFrame, difficulty: str | None = None, search: str | None = None, blooms: tuple[str, ...] = (), chunks: tuple[str, ...] = ()) -> DataFrame:
    out = mcqs
    if difficulty:
        out = out.where(F.col("difficulty") == difficulty)
    if search:
        out = out.where(F.contains(F.lower("question"), F.lit(search.lower())))
    if blooms:
        out = out.where(F.col("bloom_level").isin(*blooms))
    if chunks:
        out = out.where(F.col("source_chunk").isin(*chunks))
    return out


def verdict(flaw_rate: Column, semantic: Column) -> Column:
    return F.when((flaw_rate >= 0.8) & (semantic >= 4.0), "PASS").when((flaw_rate >= 0.7) & (semantic >= 3.5), "BORDERLINE").otherwise("FAIL")


def num_flaws(flags: str | Column) -> Column:
    """How many of a map's flags are set."""
    return F.size(F.filter(F.map_values(X.col(flags)), lambda x: F.coalesce(x, F.lit(False))))


def quiz_score(answers: DataFrame, by: str = "doc_id") -> DataFrame:
    """answers (given, answer): matches, total, percent, and the numbers of wrong rows."""
    right = F.upper(F.substring(X.strip(F.coalesce("given", F.lit(""))), 1, 1)) == F.col("answer")
    n = F.count(F.lit(1))
    return answers.groupBy(by).agg(
        F.count_if(right).alias("score"), n.alias("total"), F.round(F.count_if(right) / n * 100, 1).alias("percent"), F.array_sort(F.collect_list(F.when(~right, F.col("ord")))).alias("wrong")
    )


def judged(rows: DataFrame) -> DataFrame:
    """Adds semantic_avg (without answer_correctness) and passed."""
    mean = F.round((F.col("relevance") + F.col("answerability") + F.col("bloom_alignment")) / 3.0, 2)
    return rows.withColumn("semantic_avg", mean).withColumn("passed", F.col("semantic_avg") >= 3.5)


def judge_stats(rows: DataFrame) -> DataFrame:
    """For each chunk, and over all (chunk_id null): one GROUPING SETS aggregation."""
    return rows.groupingSets([[F.col("chunk_id")], []], F.col("chunk_id")).agg(
        F.count(F.lit(1)).alias("total_mcqs"),
        F.count_if("passed").alias("passed"),
        F.round(F.count_if("passed") / F.count(F.lit(1)) * 100, 1).alias("pass_rate"),
        *[F.round(F.sum(c) / F.count(F.lit(1)), 2).alias(f"avg_{c}") for c in ("relevance", "answerability", "bloom_alignment", "answer_correctness")],
        F.round(X.exact_mean("semantic_avg"), 2).alias("avg_semantic"),
    )


def provider_stats(calls: DataFrame) -> DataFrame:
    """Calls, tokens and mean latency in milliseconds of successful calls, by provider and model."""
    good = (F.col("status") == "success") & (F.col("latency_seconds") > 0)
    return calls.groupBy("provider", "model").agg(
        F.count(F.lit(1)).alias("calls"), F.sum("tokens").alias("tokens"), F.round(X.exact_mean(F.when(good, F.col("latency_seconds"))) * 1000, 0).alias("avg_latency_ms")
    )
