"""Record preparation, prompts, distillation and dataset building."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.functions import checks, prompts, sampling
from tallyloom.functions import text as X
from tallyloom.functions.numeric import to_number
from tallyloom.operators import ordering as O
from tallyloom.operators import records as R
from tallyloom.plans.fixtures import (
    CTE,
    NEEDS,
    altered_answer,
    answered_turns,
    call_texts,
    number_texts,
    predictions,
    sql_hash,
    sql_uniform,
    table,
    vectors,
    with_ctes,
)
from tallyloom.plans.influence import rounded
from tallyloom.plans.registry import query
from tallyloom.session import cut_lineage, scratch_scope, shuffles_freed


def q(text: str) -> str:
    """SQL string literal."""
    return "'" + text.replace("'", "''") + "'"


SQL_STRIP = "regexp_replace({0}, '^\\s+|\\s+$', '', 'g')"
SQL_WORDS = "list_filter(regexp_split_to_array({0}, '\\s+'), lambda w: w <> '')"

LAYOUTS = [
    {"instruction": "prompt", "input": "", "output": "label"},
    {"instruction": "prompt", "input": "CTX", "output": "label"},
    {"question": "prompt", "answer": "label"},
    {"goal": "prompt", "target": "label"},
    {"instruction": "INS", "prompt": "prompt", "canonical_solution": "label"},
    {"text": "prompt", "label": "label"},
    {"instruction": "prompt", "response": "label"},
    {"input": "prompt", "output": "label"},
    {"question": "prompt", "answer": "label", "instruction": "INS", "output": "OUT"},
]
_hash9 = f"{sql_hash('conv_id || chr(58) || turn', 'layout')} % {len(LAYOUTS)}"
CTE["rec"] = (
    f"SELECT conv_id, turn, prompt, label, predict, ({_hash9})::INTEGER AS layout, CASE {_hash9} "
    + " ".join(
        f"WHEN {k} THEN MAP {{{', '.join(f'{q(key)}: ' + (v if v in ('prompt', 'label') else q(v)) for key, v in layout.items())}}}"
        for k, layout in enumerate(LAYOUTS)
    )
    + " END AS f FROM pred"
)
NEEDS["rec"] = ("pred",)


def records(spark, sf_dir):
    """(conv_id, turn, prompt, label, predict, layout, fields): answers under nine record layouts."""
    rows = predictions(spark, sf_dir).withColumn(
        "layout", (sampling.hash_int("conv_id", "turn", seed="layout") % len(LAYOUTS)).cast("int")
    )
    fields = None
    for k, layout in enumerate(LAYOUTS):
        pairs = []
        for key, value in layout.items():
            pairs += [F.lit(key), F.col(value) if value in ("prompt", "label") else F.lit(value)]
        made = F.create_map(*pairs)
        fields = F.when(F.col("layout") == k, made) if fields is None else fields.when(F.col("layout") == k, made)
    return rows.withColumn("fields", fields)


_EXTRA = "f['instruction'] || CASE WHEN coalesce(f['input'], '') <> '' THEN chr(10) || f['input'] ELSE '' END"


@query(
    "parse_instruction_first",
    "PRJ1 FN8",
    with_ctes(
        "rec",
        f"""SELECT conv_id, turn, CASE layout WHEN 4 THEN 'INS' || chr(10) || prompt WHEN 1 THEN prompt || chr(10) || 'CTX' WHEN 8 THEN 'INS' ELSE prompt END AS prompt,
  CASE layout WHEN 8 THEN 'OUT' ELSE label END AS response FROM rec""",
    ),
)
def parse_instruction_first(spark, sf_dir):
    parsed = R.parse_example("fields", "instruction")
    return records(spark, sf_dir).select("conv_id", "turn", parsed.alias("p")).select("conv_id", "turn", "p.*")


@query(
    "parse_question_first",
    "PRJ1",
    with_ctes(
        "rec",
        """SELECT conv_id, turn, CASE layout WHEN 4 THEN 'INS' || chr(10) || prompt WHEN 1 THEN prompt || chr(10) || 'CTX' WHEN 6 THEN '' ELSE prompt END AS prompt,
  CASE layout WHEN 7 THEN '' ELSE label END AS response FROM rec""",
    ),
)
def parse_question_first(spark, sf_dir):
    parsed = R.parse_example("fields", "question")
    return records(spark, sf_dir).select("conv_id", "turn", parsed.alias("p")).select("conv_id", "turn", "p.*")


@query(
    "templated_text",
    "PRJ2",
    with_ctes(
        "pred",
        f"""SELECT conv_id, turn, CASE WHEN conv_id % 3 = 0 THEN 'Question: ' || prompt || chr(10) || 'Answer: ' || label
  ELSE '### Instruction:' || chr(10) || prompt || chr(10) || chr(10) || '### Response:' || chr(10) || label END AS text FROM pred""",
    ),
)
def templated_text(spark, sf_dir):
    path = F.when(F.col("conv_id") % 3 == 0, "data/x/MultiArith_test.json").otherwise("data/gsm8k/alpaca_eval.json")
    return predictions(spark, sf_dir).select("conv_id", "turn", prompts.templated(path, "prompt", "label").alias("text"))


TASKS = ["alpaca_eval", "gsm8k", "humaneval", "multiarith", "openfunction"]


@query(
    "task_prompts",
    "PRJ2",
    with_ctes(
        "pred",
        f"""SELECT conv_id, turn, task, CASE WHEN task IN ('gsm8k', 'multiarith') THEN 'Question: ' || prompt || chr(10) || 'Answer: ' || label
  ELSE '### Instruction:' || chr(10) || prompt || chr(10) || chr(10) || '### Response:' || chr(10) || label END AS text
FROM (SELECT *, ({TASKS})[conv_id % 5 + 1] AS task FROM pred)""",
    ),
)
def task_prompts(spark, sf_dir):
    task = F.element_at(F.array(*[F.lit(t) for t in TASKS]), (F.col("conv_id") % 5 + 1).cast("int"))
    rows = predictions(spark, sf_dir).withColumn("task", task)
    return rows.select("conv_id", "turn", "task", prompts.task_prompt("task", "prompt", "label").alias("text"))


_TEMPLATES = list(prompts.CHAT_TEMPLATES)


def _chat_sql() -> str:
    cases = []
    for k, (system, text, user) in enumerate(prompts.CHAT_TEMPLATES.values()):
        head = q(system.replace("{{content}}", text))
        body = q(user).replace("{{content}}", "' || prompt || '").replace("{{resp}}", "' || label || '")
        cases.append(f"WHEN {k} THEN {head} || {body}")
    return "CASE conv_id % 10 " + " ".join(cases) + " END"


@query("chat_prompts", "PRJ3", with_ctes("pred", f"SELECT conv_id, turn, {_chat_sql()} AS text FROM pred"))
def chat_prompts(spark, sf_dir):
    name = F.element_at(F.array(*[F.lit(t) for t in _TEMPLATES]), (F.col("conv_id") % 10 + 1).cast("int"))
    return predictions(spark, sf_dir).select("conv_id", "turn", prompts.chat_prompt(name, "prompt", "label").alias("text"))


def _instruction_sql() -> str:
    cases = []
    for k, (name, text) in enumerate(prompts.INSTRUCTION_FORMATS.items()):
        inp = "(label || chr(10) || prompt)" if name == "instruct" else "(prompt || chr(10) || label)"
        body = q(text).replace("{inp_stripped}", f"' || {SQL_STRIP.format(inp)} || '").replace("{inp}", f"' || {inp} || '")
        cases.append(f"WHEN {k} THEN " + body.replace("{base}", "' || predict || '"))
    return SQL_STRIP.format(f"CASE conv_id % {len(prompts.INSTRUCTION_FORMATS)} " + " ".join(cases) + " END")


@query("instruction_formats", "PRJ3", with_ctes("pred", f"SELECT conv_id, turn, {_instruction_sql()} AS text FROM pred"))
def instruction_formats(spark, sf_dir):
    names = F.array(*[F.lit(n) for n in prompts.INSTRUCTION_FORMATS])
    rows = predictions(spark, sf_dir).withColumn(
        "fmt", F.element_at(names, (F.col("conv_id") % len(prompts.INSTRUCTION_FORMATS) + 1).cast("int"))
    )
    return rows.select("conv_id", "turn", prompts.instruction_prompt("fmt", "prompt", "predict", "label").alias("text"))


@query(
    "usable_record_counts",
    "PRJ4",
    """WITH r AS (SELECT lang, CASE WHEN doc_id % 7 = 0 THEN '  ' ELSE source END AS p, CASE WHEN doc_id % 11 = 0 THEN NULL ELSE text END AS t FROM documents)
SELECT lang, count(*) FILTER (coalesce(trim(p), '') <> '' AND coalesce(trim(t), '') <> '') AS kept,
 count(*) FILTER (NOT (coalesce(trim(p), '') <> '' AND coalesce(trim(t), '') <> '')) AS skipped FROM r GROUP BY lang""",
)
def usable_record_counts(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(
        "lang",
        F.when(F.col("doc_id") % 7 == 0, "  ").otherwise(F.col("source")).alias("prompt"),
        F.when(F.col("doc_id") % 11 != 0, F.col("text")).alias("response"),
    )
    return R.keep_usable(rows, ["lang"], "prompt", "response")[1]


@query(
    "meta_values",
    "PRJ5",
    """SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'e' || event_id WHEN event_id % 3 = 1 THEN 'u' || user_id ELSE 'task_' || event_id END AS sample_uid,
  CASE WHEN event_id % 2 = 0 THEN event_type ELSE 'unknown' END AS domain_label FROM events""",
)
def meta_values(spark, sf_dir):
    nothing = F.lit(None).cast("string")
    fields = F.create_map(
        F.lit("id"), F.when(F.col("event_id") % 3 == 0, F.concat(F.lit(" e"), "event_id", F.lit(" "))).otherwise("  "),
        F.lit("uid"), F.when(F.col("event_id") % 3 == 1, F.concat(F.lit("u"), "user_id")).otherwise(nothing),
        F.lit("category"), F.when(F.col("event_id") % 2 == 0, F.col("event_type")).otherwise(nothing),
    )
    rows = table(spark, sf_dir, "events").withColumn("fields", fields)
    return rows.select(
        "event_id",
        R.meta_value("fields", ["id", "uid", "sample_id"], F.concat(F.lit("task_"), "event_id")).alias("sample_uid"),
        R.meta_value("fields", ["domain", "category", "topic"], F.lit("unknown")).alias("domain_label"),
    )


@query(
    "content_flags",
    "PRJ6 FN4",
    f"""SELECT page_id, regexp_matches(html, {q(X.CODE_HINT)}) AS has_code, regexp_matches(html, {q(X.MATH_HINT)}) AS has_math FROM pages""",
)
def content_flags(spark, sf_dir):
    return table(spark, sf_dir, "pages").select(
        "page_id", X.contains_code("html").alias("has_code"), X.contains_math("html").alias("has_math")
    )


@query(
    "length_features",
    "PRJ7",
    with_ctes(
        "pred",
        f"""SELECT conv_id, turn, length(prompt)::INTEGER AS input_chars, length(label)::INTEGER AS output_chars, len({SQL_WORDS.format('prompt')})::INTEGER AS input_words,
  len({SQL_WORDS.format('label')})::INTEGER AS output_words FROM pred""",
    ),
)
def length_features(spark, sf_dir):
    return predictions(spark, sf_dir).select("conv_id", "turn", *R.length_features("prompt", "label"))


@query(
    "noisy_labels",
    "PRJ8 JOIN9",
    f"""WITH r AS (SELECT vec_id, label % 2 AS y, row_number() OVER (ORDER BY {sql_hash("vec_id::VARCHAR", "noise")}, vec_id) - 1 AS p, count(*) OVER () AS n FROM embeddings)
SELECT vec_id, CASE WHEN p < floor(0.2::DOUBLE * n) THEN 1 - y ELSE y END AS y, p < floor(0.2::DOUBLE * n) AS is_noisy FROM r""",
)
def noisy_labels(spark, sf_dir):
    rows = vectors(spark, sf_dir).select("vec_id", (F.col("label") % 2).alias("y"))
    return R.flip_noisy_labels(rows, ["vec_id"], "y", 0.2).select("vec_id", "y", "is_noisy")


@query(
    "capped_splits",
    "PRJ9",
    f"""SELECT o_orderkey, is_val FROM (SELECT o_orderkey, {sql_uniform("o_orderkey::VARCHAR", "valid")} < 0.2 AS is_val,
  {sql_uniform("o_orderkey::VARCHAR", "cap")} AS u FROM orders) WHERE u < CASE WHEN is_val THEN 0.5::DOUBLE ELSE 0.9::DOUBLE END""",
)
def capped_splits(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(
        "o_orderkey", (sampling.uniform("o_orderkey", seed="valid") < 0.2).alias("is_val")
    )
    train, val = R.sample_both_splits(rows.where(~F.col("is_val")), rows.where("is_val"), ["o_orderkey"], 0.9, 0.5)
    return train.unionByName(val)


@query(
    "ordinal_slice",
    "PRJ10 WIN8",
    """SELECT doc_id, p AS ordinal FROM (SELECT doc_id, row_number() OVER (ORDER BY source, doc_id) - 1 AS p FROM documents) WHERE p >= 50 AND p < 150""",
)
def ordinal_slice(spark, sf_dir):
    rows = O.positions(table(spark, sf_dir, "documents").select("doc_id", "source"), [], ["source", "doc_id"], "ordinal")
    return R.ordinal_slice(rows, "ordinal", 50, 100).select("doc_id", "ordinal")


@query(
    "answer_texts",
    "PRJ12 UDTF1 FN8",
    with_ctes(
        "pred",
        f"""SELECT conv_id, turn, p::INTEGER AS place, t[p + 1] AS text FROM (SELECT conv_id, turn,
  CASE conv_id % 6 WHEN 0 THEN [l] WHEN 1 THEN [pp, l] WHEN 2 THEN [l, pp] WHEN 3 THEN [l, l] WHEN 4 THEN CASE WHEN length(pp) > 20 THEN [pp] ELSE [] END ELSE [] END AS t
  FROM (SELECT conv_id, turn, {SQL_STRIP.format('label')} AS l, {SQL_STRIP.format('prompt')} AS pp FROM pred)) , generate_series(0, 3) g(p) WHERE p < len(t)""",
    ),
)
def answer_texts(spark, sf_dir):
    def text(c):
        return F.struct(F.col(c).alias("content"))

    raw = (
        F.when(F.col("conv_id") % 6 == 0, F.to_json(F.struct(F.col("label").alias("output"))))
        .when(F.col("conv_id") % 6 == 1, F.to_json(F.struct(F.array(text("prompt"), text("label")).alias("messages"))))
        .when(
            F.col("conv_id") % 6 == 2,
            F.concat(
                F.lit('{"choices": ['), F.to_json(F.struct(text("label").alias("message"))), F.lit(", "),
                F.to_json(F.struct(F.col("prompt").alias("text"))), F.lit("]}"),
            ),
        )
        .when(F.col("conv_id") % 6 == 3, F.to_json(F.struct(F.struct(F.col("label").alias("text")).alias("answer"))))
        .when(F.col("conv_id") % 6 == 4, F.to_json(F.struct(F.col("prompt").alias("remark"), F.lit("short").alias("note"))))
        .otherwise("{broken")
    )
    rows = predictions(spark, sf_dir).select("conv_id", "turn", R.answer_texts(raw).alias("t"))
    return rows.select("conv_id", "turn", F.posexplode("t").alias("place", "text"))


CTE["prob"] = """
SELECT p_partkey, p_name AS question, CASE WHEN p_size % 2 = 0 THEN 'def make(): # ' || p_type ELSE '' END AS starter,
  CASE WHEN p_size % 3 = 0 THEN '{"fn_name": "make"}' WHEN p_size % 3 = 1 THEN '{"inputs": []}' ELSE '' END AS io, p_size, p_brand, p_type FROM part"""


def problems(spark, sf_dir):
    """Coding problems from parts; one in five has an unreadable list of solutions."""
    solutions = F.when(F.col("p_partkey") % 5 == 4, "not json").otherwise(
        F.to_json(F.transform(F.sequence(F.lit(1), F.col("p_size") % 3 + 1), lambda k: F.concat(F.col("p_brand"), F.lit("-"), k.cast("string"))))
    )
    return table(spark, sf_dir, "part").select(
        "p_partkey",
        F.col("p_name").alias("question"),
        F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("def make(): # "), "p_type")).otherwise("").alias("starter"),
        F.when(F.col("p_size") % 3 == 0, '{"fn_name": "make"}').when(F.col("p_size") % 3 == 1, '{"inputs": []}').otherwise("").alias("io"),
        solutions.alias("solutions"),
    )


@query(
    "problem_solutions",
    "PRJ13",
    with_ctes(
        "prob",
        """SELECT p_partkey, question, p_brand || '-' || k AS solution FROM prob, generate_series(1, 3) g(k)
WHERE p_partkey % 5 <> 4 AND k <= p_size % 3 + 1 AND CASE WHEN p_size % 2 = 0 THEN 4 ELSE 0 END + 2 < 6""",
    ),
)
def problem_solutions(spark, sf_dir):
    tokens = X.word_count("question") + X.word_count("starter")
    rows, _ = R.explode_solutions(problems(spark, sf_dir), "solutions", 6, tokens)
    return rows.select("p_partkey", "question", "solution")


@query(
    "problem_skips",
    "PRJ13",
    with_ctes(
        "prob",
        """SELECT count(*) FILTER (p_partkey % 5 = 4) AS skipped_problems,
  (coalesce(sum(p_size % 3 + 1) FILTER (p_partkey % 5 <> 4 AND p_size % 2 = 0), 0))::BIGINT AS skipped_long FROM prob""",
    ),
)
def problem_skips(spark, sf_dir):
    tokens = X.word_count("question") + X.word_count("starter")
    return R.explode_solutions(problems(spark, sf_dir), "solutions", 6, tokens)[1]


@query(
    "stop_token_prefix",
    "PRJ14",
    """SELECT doc_id, length(t)::INTEGER AS kept_chars, md5(t) AS kept_md5 FROM (SELECT doc_id, substr(text, 1, least(
  CASE WHEN instr(text, '. E') = 0 THEN length(text) + 1 ELSE instr(text, '. E') END, CASE WHEN instr(text, chr(10)) = 0 THEN length(text) + 1 ELSE instr(text, chr(10)) END,
  CASE WHEN instr(text, ' the ') = 0 THEN length(text) + 1 ELSE instr(text, ' the ') END) - 1) AS t FROM documents)""",
)
def stop_token_prefix(spark, sf_dir):
    cut = X.before_first("text", [". E", "\n", " the "])
    return table(spark, sf_dir, "documents").select("doc_id", F.length(cut).alias("kept_chars"), F.md5(cut).alias("kept_md5"))


@query(
    "generation_postprocess",
    "PRJ15 UDF2",
    with_ctes(
        "pred",
        f"""SELECT conv_id, turn, prompt || split_part(label, chr(10), 1) AS continuation,
  {SQL_STRIP.format("predict")} AS after_answer, split_part({SQL_STRIP.format("label")}, chr(10), 1) AS first_line,
  {SQL_STRIP.format("label")} || chr(10) || 'print(solution())' AS program,
  {SQL_STRIP.format("split_part(label, '.', 1)")} AS completion, {SQL_STRIP.format("label")} AS code FROM pred""",
    ),
)
def generation_postprocess(spark, sf_dir):
    rows = predictions(spark, sf_dir)
    prompt, label, predict = F.col("prompt"), F.col("label"), F.col("predict")

    def text(*parts):
        return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])

    return rows.select(
        "conv_id",
        "turn",
        R.continuation(text(prompt, label), "prompt", ["\n", "\ndef"]).alias("continuation"),
        X.strip(X.after_first(text("\nQUESTION:\n", prompt, "\nANSWER:", predict), "\nANSWER:")).alias("after_answer"),
        R.first_answer_line(text(prompt, "\n# Comment:", label, "\n# Comment:x"), "# Comment:").alias("first_line"),
        R.math_program(
            text("# solution in Python:", prompt, "# solution in Python:", label, "Q: next"), 1, "print(solution())"
        ).alias("program"),
        R.completion_between(
            text(prompt, "BEGIN SOLUTION\n<code>", label), ["BEGIN SOLUTION\n<code>", "# SOLUTION START"], ["."]
        ).alias("completion"),
        R.unfenced(
            text("x ### Response: ok\n```python\n", label, '\n```\nthat is it</s> tail')
        ).alias("code"),
    )


@query(
    "two_shot_prompts",
    "PRJ16",
    with_ctes(
        "pred",
        f"""SELECT conv_id, turn, md5({q(prompts.TWO_SHOT_ENTRY)} || {" || ".join(
            f"chr(10) || 'Instruction:' || chr(10) || {i} || {q(prompts.SHOT_GAP)} || chr(10) || 'Solution:' || chr(10) || {s}" + (f" || {q(prompts.SHOT_GAP)}" if last else "")
            for i, s, last in (("e1.p", "e1.l", True), ("e2.p", "e2.l", True), (SQL_STRIP.format("prompt"), "''", False))
        )}) AS prompt_md5 FROM pred
CROSS JOIN (SELECT any_value(text) AS p, any_value(item_id)::VARCHAR AS l FROM benchmark WHERE item_id = (SELECT min(item_id) FROM benchmark)) e1
CROSS JOIN (SELECT any_value(text) AS p, any_value(item_id)::VARCHAR AS l FROM benchmark WHERE item_id = (SELECT min(item_id) FROM benchmark WHERE item_id > (SELECT min(item_id) FROM benchmark))) e2""",
    ),
)
def two_shot_prompts(spark, sf_dir):
    examples = table(spark, sf_dir, "benchmark")
    shot = F.concat(
        F.lit("\nInstruction:\n"), "text", F.lit(prompts.SHOT_GAP + "\nSolution:\n"), F.col("item_id").cast("string"), F.lit(prompts.SHOT_GAP)
    )
    prefix = R.shot_prefix(examples, "item_id", 2, shot)
    rows = R.with_prefix(predictions(spark, sf_dir), prefix)
    text = F.concat(
        F.lit(prompts.TWO_SHOT_ENTRY), "prefix", F.lit("\nInstruction:\n"), X.strip("prompt"), F.lit(prompts.SHOT_GAP + "\nSolution:\n")
    )
    return rows.select("conv_id", "turn", F.md5(text).alias("prompt_md5"))


MATH_SHOTS = 3


@query(
    "math_shot_prompts",
    "PRJ16",
    f"""WITH prefix AS (SELECT string_agg('Q: ' || question || chr(10) || chr(10) || '# solution in Python:' || chr(10) || chr(10) || chr(10) || 'def solution():' || chr(10) || '    \"\"\"' || question || '\"\"\"' || chr(10) || solution || repeat(chr(10), 6), '' ORDER BY r) AS t
  FROM (SELECT *, row_number() OVER (ORDER BY p_partkey) AS r FROM (SELECT p_partkey, p_name AS question, '    return ' || p_size AS solution FROM part) QUALIFY r <= {MATH_SHOTS}))
SELECT p_partkey, md5(t || 'Q: ' || p_name || chr(10) || chr(10) || '# solution in Python:' || chr(10) || chr(10) || chr(10)) AS prompt_md5 FROM part CROSS JOIN prefix""",
)
def math_shot_prompts(spark, sf_dir):
    """Three solved examples before every question."""
    parts = table(spark, sf_dir, "part").select(
        "p_partkey", F.col("p_name").alias("question"), F.concat(F.lit("    return "), F.col("p_size").cast("string")).alias("solution")
    )
    prefix = R.shot_prefix(parts, "p_partkey", MATH_SHOTS, prompts.math_shot("question", "solution"))
    rows = R.with_prefix(parts, prefix)
    return rows.select("p_partkey", F.md5(F.concat("prefix", prompts.math_target("question"))).alias("prompt_md5"))


@query(
    "problem_prompts",
    "PRJ17",
    with_ctes(
        "prob",
        """SELECT p_partkey, chr(10) || 'QUESTION:' || chr(10) || question || starter || chr(10) ||
  CASE WHEN p_size % 3 = 0 THEN 'Use Call-Based format' ELSE 'Use Standard Input format' END || chr(10) || 'ANSWER:' || chr(10) AS prompt FROM prob""",
    ),
)
def problem_prompts(spark, sf_dir):
    return problems(spark, sf_dir).select("p_partkey", prompts.problem_prompt("question", "starter", "io").alias("prompt"))


@query(
    "infill_prompts",
    "PRJ18",
    with_ctes("pred", "SELECT conv_id, turn, '<fim-prefix>' || prompt || '<fim-suffix>' || label || '<fim-middle>' AS text FROM pred"),
)
def infill_prompts(spark, sf_dir):
    return predictions(spark, sf_dir).select("conv_id", "turn", prompts.infill_prompt("prompt", "label").alias("text"))


@query(
    "normalized_tags",
    "PRJ19",
    """SELECT o_orderkey, CASE WHEN k IN (0, 1, 5) THEN 'epoch_' || k WHEN o_orderkey % 3 = 0 THEN k::VARCHAR WHEN o_orderkey % 3 = 1 THEN 'epoch' || k ELSE 'epoch_' || k END AS epoch,
  CASE o_orderkey % 4 WHEN 0 THEN 'sft,sdft' WHEN 1 THEN 'sdft,sft' WHEN 2 THEN 'sft' ELSE '' END AS methods
FROM (SELECT o_orderkey, (year(o_orderdate) - 1995)::INTEGER AS k FROM orders)""",
)
def normalized_tags(spark, sf_dir):
    k = (F.year("o_orderdate") - 1995).cast("string")
    rows = table(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit(" "), k))
        .when(F.col("o_orderkey") % 3 == 1, F.concat(F.lit("epoch"), k))
        .otherwise(F.concat(F.lit("epoch_"), k, F.lit(" ")))
        .alias("tag"),
        F.when(F.col("o_orderkey") % 4 == 0, F.array(F.lit("Both"), F.lit("sft")))
        .when(F.col("o_orderkey") % 4 == 1, F.array(F.lit("sdft"), F.lit(" ALL ")))
        .when(F.col("o_orderkey") % 4 == 2, F.array(F.lit("sft"), F.lit("sft")))
        .otherwise(F.array(F.lit("rlhf")))
        .alias("m"),
    )
    return rows.select("o_orderkey", R.epoch_tag("tag").alias("epoch"), F.array_join(R.unique_methods("m"), ",").alias("methods"))


@query(
    "acceptable_answers",
    "PRJ21",
    with_ctes(
        "pred",
        f"""SELECT conv_id, turn, NOT ({" OR ".join(f"contains(lower(predict), {q(b)})" for b in checks.BANNED_PHRASES)} OR starts_with(predict, {q(checks.BANNED_OPENING)})) AS acceptable FROM pred""",
    ),
)
def acceptable_answers(spark, sf_dir):
    return predictions(spark, sf_dir).select("conv_id", "turn", checks.acceptable("predict").alias("acceptable"))


_LAST = "regexp_extract_all({0}, '-?\\d+(?:[,\\s]\\d+)*(?:\\.\\d+)?')[-1]"
_CLEAN = "replace(replace(" + _LAST + ", ',', ''), ' ', '')"
SQL_LAST_INTEGER = (
    "CASE WHEN len(regexp_extract_all({0}, '\\d')) = 0 OR regexp_matches(" + _CLEAN + ", '\\.\\d*[1-9]\\d*$') THEN '-999999999' "
    "ELSE regexp_replace(" + _CLEAN + ", '\\.\\d+$', '') END"
)
SQL_MATH = (
    "(" + SQL_LAST_INTEGER.format("label") + ")::HUGEINT = (" + SQL_LAST_INTEGER.format(SQL_STRIP.format("predict")) + ")::HUGEINT"
)
_STD = "replace(replace(regexp_replace(" + SQL_STRIP + ", '\\s+', ' ', 'g'), '''', '\"'), ', ', ',')"
SQL_CALL = f"regexp_matches({_STD.format('predict')}, '(^|[^A-Za-z0-9_])' || regexp_escape({_STD.format('label')}))"
SQL_SHAPE = (
    f"contains({SQL_STRIP.format('predict')}, '```python') AND ("
    + " OR ".join(f"starts_with({SQL_STRIP.format('predict')}, '{o}')" for o in checks.CODE_OPENINGS)
    + ")"
)

CTE["codeans"] = """
SELECT doc_id, text AS label, CASE doc_id % 4 WHEN 0 THEN 'Here is the code:' || chr(10) || '```python' || chr(10) || text WHEN 1 THEN '  I implemented it ```python x``` ' || text
  WHEN 2 THEN 'Sure ```python' || text ELSE 'I have done it. ' || text END AS predict, source FROM documents"""


def code_texts():
    """label and predict of a document."""
    case = F.col("doc_id") % 4
    predict = (
        F.when(case == 0, F.concat(F.lit("Here is the code:\n```python\n"), "text"))
        .when(case == 1, F.concat(F.lit("  I implemented it ```python x``` "), "text"))
        .when(case == 2, F.concat(F.lit("Sure ```python"), "text"))
        .otherwise(F.concat(F.lit("I have done it. "), "text"))
    )
    return F.col("text"), predict


def code_answers(spark, sf_dir):
    label, predict = code_texts()
    return table(spark, sf_dir, "documents").select("doc_id", label.alias("label"), predict.alias("predict"), "source")


CTE["dist"] = f"""
SELECT 'gsm8k' AS dataset, row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, label, predict) - 1 AS ordinal, label, predict, {SQL_MATH} AS ok FROM answers
UNION ALL SELECT 'openfunction', row_number() OVER (ORDER BY p_partkey) - 1, label, predict, {SQL_CALL} FROM calls
UNION ALL SELECT 'magicoder', row_number() OVER (ORDER BY doc_id) - 1, label, predict, {SQL_SHAPE} FROM codeans
UNION ALL SELECT 'alpaca', row_number() OVER (ORDER BY conv_id, turn) - 1, label, predict, true FROM pred"""
CTE["distilled"] = f"""
SELECT dataset, ordinal, {SQL_STRIP.format("label")} AS label, ok AND NOT ({" OR ".join(f"contains(lower(predict), {q(b)})" for b in checks.BANNED_PHRASES)}) AS replaced,
  CASE WHEN ok AND NOT ({" OR ".join(f"contains(lower(predict), {q(b)})" for b in checks.BANNED_PHRASES)}) THEN {SQL_STRIP.format("predict")} ELSE {SQL_STRIP.format("label")} END AS answer FROM dist"""
NEEDS.update({"dist": ("answers", "calls", "codeans", "pred"), "distilled": ("dist",)})


def prediction_table(spark, sf_dir):
    """(dataset, ordinal, label, predict) over four datasets, ordinals taken once.

    Rows are numbered as they are in their tables, texts are made of numbered rows. The table is dealt out by its key here,
    and both texts stand in one value, which no reader takes apart before that: so all sides of joins by the key are the
    same shuffle, which is written once.
    """

    def numbered(rows, dataset, order, label, predict):
        rows = O.positions(rows, [], order, "ordinal")
        return rows.select(F.lit(dataset).alias("dataset"), "ordinal", F.array(label, predict).alias("texts"))

    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_type")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    turns = answered_turns(spark, sf_dir).select("conv_id", "turn", "label")
    with shuffles_freed(spark), scratch_scope(spark):
        numbers = number_texts()
        tables = [
            numbered(lines, "gsm8k", ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", *numbers], *numbers),
            numbered(parts, "openfunction", ["p_partkey"], *call_texts()),
            numbered(docs, "magicoder", ["doc_id"], *code_texts()),
            numbered(turns, "alpaca", ["conv_id", "turn"], F.col("label"), altered_answer()),
        ]
        out = tables[0]
        for other in tables[1:]:
            out = out.unionByName(other)
        # what an ingest would write: the table with its ordinals
        out = cut_lineage(out, keep=True, codec="zstd")
    texts = F.col("texts")
    return out.repartition("dataset", "ordinal").select(
        "dataset", "ordinal", F.get(texts, F.lit(0)).alias("label"), F.get(texts, F.lit(1)).alias("predict")
    )


def distilled(preds):
    fields = F.create_map(F.lit("question"), F.concat(F.lit("item "), "ordinal"), F.lit("answer"), F.concat(F.lit(" "), "label", F.lit("\n")))
    originals = preds.select("dataset", "ordinal", fields.alias("fields"))
    out = R.distill(originals, preds)
    return out.select("dataset", "ordinal", "answer_key", "replaced", F.try_element_at("fields", F.col("answer_key")).alias("answer"))


@query(
    "distilled_dataset",
    "PRJ20 PRJ22 JOIN1 UDF1",
    with_ctes("distilled", "SELECT dataset, ordinal, 'answer' AS answer_key, replaced, md5(answer) AS answer_md5 FROM distilled"),
)
def distilled_dataset(spark, sf_dir):
    out = distilled(prediction_table(spark, sf_dir))
    return out.select("dataset", "ordinal", "answer_key", "replaced", F.md5("answer").alias("answer_md5"))


@query(
    "answer_differences",
    "EV5",
    with_ctes("distilled", "SELECT dataset, ordinal + 1 AS position FROM distilled WHERE answer <> label"),
)
def answer_differences(spark, sf_dir):
    return compared(spark, sf_dir).where("differs").select("dataset", "position")


@query(
    "answer_difference_rate",
    "EV5",
    with_ctes(
        "distilled",
        "SELECT dataset, count(*) AS total, count(*) FILTER (answer <> label) AS differing, round(100.0 * count(*) FILTER (answer <> label) / count(*)::DOUBLE, 6) AS diff_pct FROM distilled GROUP BY dataset",
    ),
)
def answer_difference_rate(spark, sf_dir):
    out = R.difference_rate(compared(spark, sf_dir), ["dataset"])
    return out.withColumn("diff_pct", F.round("diff_pct", 6))


def compared(spark, sf_dir):
    preds = prediction_table(spark, sf_dir)
    original = preds.select("dataset", "ordinal", F.col("label").alias("answer"))
    return R.answer_differences(original, distilled(preds), ["dataset"], "ordinal", "answer")


PACK, SHARDS = 64, 4
_W = SQL_WORDS


@query(
    "packed_samples",
    "PRJ23",
    with_ctes(
        "pred",
        f"""SELECT shard::INTEGER AS shard, bin, count(*) AS n_samples, least({PACK}, sum(n))::BIGINT AS n_tokens,
  md5(array_to_string(list_slice(flatten(list(toks ORDER BY off)), 1, {PACK}), ' ')) AS input_md5,
  md5(array_to_string(list_slice(flatten(list(labs ORDER BY off)), 1, {PACK}), ' ')) AS labels_md5 FROM (
 SELECT *, floor(off / {PACK})::BIGINT AS bin FROM (
  SELECT *, coalesce(sum(n) OVER (PARTITION BY shard ORDER BY h, conv_id, turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM (
   SELECT conv_id, turn, {sql_hash("conv_id || ':' || turn", "pack")} AS h, {sql_hash("conv_id || ':' || turn", "pack")} % {SHARDS} AS shard,
    list_concat({_W.format("prompt")}, list_append({_W.format("label")}, '<eos>')) AS toks,
    list_concat(list_transform({_W.format("prompt")}, lambda w: '-100'), list_append({_W.format("label")}, '<eos>')) AS labs,
    len({_W.format("prompt")}) + len({_W.format("label")}) + 1 AS n FROM pred))) GROUP BY shard, bin""",
    ),
)
def packed_samples(spark, sf_dir):
    rows = predictions(spark, sf_dir).withColumn("n", (X.word_count("prompt") + X.word_count("label") + 1).cast("bigint"))
    binned = R.pack_bins(rows, ["conv_id", "turn"], "n", PACK, SHARDS, "pack")
    packed = R.packed_sequences(binned, "prompt", "label", PACK, "<eos>")
    return packed.select(
        "shard",
        "bin",
        "n_samples",
        F.size("input").cast("bigint").alias("n_tokens"),
        F.md5(F.array_join("input", " ")).alias("input_md5"),
        F.md5(F.array_join("labels", " ")).alias("labels_md5"),
    )


PROBS = {"en": 0.5, "fr": 0.2, "de": 0.2, "es": 0.1}
_PCASE = "CASE lang " + " ".join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in PROBS.items()) + " END"
CTE["mixed"] = f"""
SELECT doc_id, lang, {_PCASE} AS p, row_number() OVER (PARTITION BY lang ORDER BY {sql_hash("doc_id::VARCHAR", "mix")}, doc_id) - 1 AS r, count(*) OVER (PARTITION BY lang) AS n FROM documents"""


def _mix_sql(pick: str, copies: str) -> str:
    return with_ctes(
        "mixed",
        f""", h AS (SELECT {pick}(n / p) AS hz FROM mixed),
x AS (SELECT doc_id, lang, c AS copy, (r + c * n + {sql_uniform("doc_id || ':' || c", "mix-place")}) / p AS place, hz FROM mixed CROSS JOIN h CROSS JOIN generate_series(0, 50) g(c) WHERE c <= {copies})
SELECT doc_id, lang, copy, round(place, 6) AS place FROM x WHERE place < hz""",
    )


@query("mixed_datasets_under", "PRJ24", _mix_sql("min", "0"))
def mixed_datasets_under(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang")
    out = R.interleave(rows, "lang", ["doc_id"], PROBS, "under", "mix")
    return out.select("doc_id", "lang", "copy", F.round("place", 6).alias("place"))


@query("mixed_datasets_over", "PRJ24", _mix_sql("max", "greatest(0, ceil(hz * p / n) - 1)"))
def mixed_datasets_over(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang")
    out = R.interleave(rows, "lang", ["doc_id"], PROBS, "over", "mix")
    return out.select("doc_id", "lang", "copy", F.round("place", 6).alias("place"))


@query("mixed_datasets_concat", "PRJ24", with_ctes("mixed", "SELECT doc_id, lang, 0::BIGINT AS copy, r::DOUBLE AS place FROM mixed"))
def mixed_datasets_concat(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang")
    return R.interleave(rows, "lang", ["doc_id"], PROBS, "concat", "mix").select("doc_id", "lang", "copy", "place")


@query(
    "number_coercion",
    "PRJ11",
    """WITH t AS (SELECT l_returnflag, CASE l_linenumber % 6 WHEN 0 THEN 'nan' WHEN 1 THEN ' ' || l_quantity::BIGINT || ' ' WHEN 2 THEN l_partkey || 'e-2' WHEN 3 THEN 'inf'
  WHEN 4 THEN 'about ' || l_partkey ELSE '' END AS x, CASE l_linenumber % 6 WHEN 1 THEN l_quantity WHEN 2 THEN l_partkey / 100.0 END AS v FROM lineitem)
SELECT l_returnflag, count(*) AS n, count(v) AS n_numbers, round(sum(v), 6) AS total FROM t GROUP BY l_returnflag""",
)
def number_coercion(spark, sf_dir):
    """Numbers read from text: padded, in scientific notation, not finite, mixed with words or empty."""
    case = F.col("l_linenumber") % 6
    key = F.col("l_partkey").cast("string")
    text = (
        F.when(case == 0, "nan")
        .when(case == 1, F.concat(F.lit(" "), F.col("l_quantity").cast("bigint").cast("string"), F.lit(" ")))
        .when(case == 2, F.concat(key, F.lit("e-2")))
        .when(case == 3, "inf")
        .when(case == 4, F.concat(F.lit("about "), key))
        .otherwise("")
    )
    out = table(spark, sf_dir, "lineitem").select("l_returnflag", to_number(text).alias("v")).groupBy("l_returnflag").agg(
        F.count(F.lit(1)).alias("n"), F.count("v").alias("n_numbers"), F.sum("v").alias("total")
    )
    return rounded(out, "total")


@query(
    "split_and_class_ids",
    "PRJ25",
    f"""SELECT p_partkey, CASE WHEN u < 0.8 THEN 'train' WHEN u < 0.9 THEN 'test' ELSE 'valid' END AS split, (dense_rank() OVER (ORDER BY p_type) - 1)::INTEGER AS label_id
FROM (SELECT p_partkey, p_type, {sql_uniform("p_partkey::VARCHAR", "split3")} AS u FROM part)""",
)
def split_and_class_ids(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_type")
    rows = R.hash_split(rows, ["p_partkey"], {"train": 0.8, "test": 0.9, "valid": 1.0}, "split3")
    return R.class_ids(rows, "p_type").select("p_partkey", "split", "label_id")


_VOWEL, _CONS = "[aeiouAEIOU]", "[bcdfghjklmnpqrstvwxyzBCDFGHJKLMNPQRSTVWXYZ]"
_WT = "array_to_string(list_transform(" + _W.format("s") + ", lambda w: {0}), ' ')"
TRANSFORM_SQL = {
    "Reverse Order of Words": f"array_to_string(list_reverse({_W.format('s')}), ' ')",
    "Capitalize Every Other Letter": "array_to_string(list_transform(generate_series(1, length(s)), lambda i: CASE WHEN i % 2 = 1 THEN lower(s[i]) ELSE upper(s[i]) END), '')",
    "Insert Number 1 Between Every Word": f"array_to_string({_W.format('s')}, ' 1 ')",
    "Replace Vowels with *": f"regexp_replace(s, '{_VOWEL}', '*', 'g')",
    "Double Every Consonant": f"regexp_replace(s, '({_CONS})', '\\1\\1', 'g')",
    "Capitalize Every Word": _WT.format("upper(w[1]) || lower(w[2:])"),
    "Remove All Vowels": f"regexp_replace(s, '{_VOWEL}', '', 'g')",
    "Add 'ly' To End of Each Word": _WT.format("w || 'ly'"),
    "Remove All Consonants": f"regexp_replace(s, '{_CONS}', '', 'g')",
    "Repeat Each Word Twice": _WT.format("w || ' ' || w"),
}


@query(
    "transformation_dataset",
    "PRJ26 FN1 UDF3",
    "WITH ph AS (SELECT p_partkey, p_name || ' ' || p_type || ' ' || p_brand || '.' AS s, row_number() OVER (ORDER BY p_partkey DESC) <= 10 AS is_test FROM part),\nx AS ("
    + "\nUNION ALL ".join(f"SELECT p_partkey, s, is_test, {q(n)} AS variation, {e} AS answer FROM ph" for n, e in TRANSFORM_SQL.items())
    + """) SELECT p_partkey, variation, answer, CASE WHEN is_test THEN 'test' ELSE 'train' END AS split,
  md5('Bot is a chatbot that performs a specific transformation on sentences: ' || variation || chr(10) || '    For example:' || chr(10) || '    ' || s || ' ->  ' || answer || '</s>') AS text_md5 FROM x""",
)
def transformation_dataset(spark, sf_dir):
    phrases = table(spark, sf_dir, "part").select(
        "p_partkey", F.concat("p_name", F.lit(" "), "p_type", F.lit(" "), "p_brand", F.lit(".")).alias("phrase")
    )
    out = R.transformation_dataset(phrases, "phrase", ["p_partkey"])
    return out.select("p_partkey", "variation", "answer", "split", F.md5("text").alias("text_md5"))


COUNTER_SQL = {
    "Count Occurrences of letter A": "len(regexp_extract_all(text, '[aA]'))",
    "Count Words": f"len({_W.format('text')})",
    "Count Uppercase Letters": "len(regexp_extract_all(text, '\\p{Lu}'))",
    "Count Vowels": f"len(regexp_extract_all(text, '{_VOWEL}'))",
    "Count Consonants": f"len(regexp_extract_all(text, '{_CONS}'))",
    "Count Numbers": "len(regexp_extract_all(text, '\\p{Nd}'))",
    "Count Characters Without Spaces": "length(replace(text, ' ', ''))",
    "Count Words that end in a vowel": f"len(list_filter({_W.format('text')}, lambda w: contains('aeiou', lower(w[-1]))))",
    "Count Non-Alphanumeric Characters": "len(regexp_extract_all(text, '[^\\p{L}\\p{N}\\s]'))",
    "Count Words Longer Than 4 Letters": f"len(list_filter({_W.format('text')}, lambda w: length(w) > 4))",
}


@query(
    "text_counters",
    "FN2 UDF3",
    "SELECT doc_id, " + ", ".join(f"({e})::INTEGER AS c{k}" for k, e in enumerate(COUNTER_SQL.values())) + " FROM documents",
)
def text_counters(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(
        "doc_id", *[X.COUNTERS[name]("text").cast("int").alias(f"c{k}") for k, name in enumerate(COUNTER_SQL)]
    )


def _math_sql() -> str:
    cases, reasons, answers = [], [], []
    for name, (problem, reason, solution) in prompts.MATH_PROBLEMS.items():
        def slot(t):
            out = q(t)
            for letter in "ABCD":
                out = out.replace("{" + letter + "}", f"' || {letter.lower()} || '")
            return out

        cases.append(f"WHEN {q(name)} THEN {slot(problem)}")
        reasons.append(f"WHEN {q(name)} THEN {slot(reason)}")
        answers.append(f"WHEN {q(name)} THEN ({solution})::BIGINT")
    names = ", ".join(q(n) for n in prompts.MATH_PROBLEMS)
    draws = ", ".join(f"""{sql_hash("variation || ':' || s_suppkey", "math" + x)} % 99 + 1 AS {x}""" for x in "abcd")
    return f"""WITH d AS (SELECT s_suppkey, variation, {draws} FROM supplier CROSS JOIN (SELECT unnest([{names}]) AS variation) v)
SELECT s_suppkey, variation, CASE WHEN {sql_uniform("s_suppkey::VARCHAR", "math-split")} < 0.9 THEN 'train' ELSE 'test' END AS split,
  CASE variation {" ".join(answers)} END AS answer, CASE variation {" ".join(reasons)} END AS reason,
  'Solve the following math problem. ' || (CASE variation {" ".join(cases)} END) || ' -> Reason: ' || (CASE variation {" ".join(reasons)} END) || ' Answer: ' || (CASE variation {" ".join(answers)} END) || '</s>' AS text FROM d"""


@query("math_dataset", "PRJ27", _math_sql())
def math_dataset(spark, sf_dir):
    out = R.math_dataset(table(spark, sf_dir, "supplier").select("s_suppkey"), ["s_suppkey"])
    return out.select("s_suppkey", "variation", "split", "answer", "reason", "text")


@query(
    "perturbation_seeds",
    "PRJ28",
    "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem WHERE l_linenumber - 1 < 5",
)
def perturbation_seeds(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").withColumn("seed", F.col("l_linenumber") - 1)
    return rows.where(F.col("seed") < 5).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


SHOTS = 3
CTE["mc"] = f"""
SELECT p_partkey, p_brand AS subject, 'Which kind is ' || p_name || '?' AS question, p_type AS a, p_brand AS b, p_size::VARCHAR AS c, p_name AS d,
  substr('ABCD', (p_partkey % 4 + 1)::INTEGER, 1) AS answer, {sql_uniform("p_partkey::VARCHAR", "dev")} < 0.2 AS is_dev FROM part"""
_MCQ = "question || chr(10) || 'A. ' || a || chr(10) || 'B. ' || b || chr(10) || 'C. ' || c || chr(10) || 'D. ' || d || chr(10) || 'Answer: '"


def choice_items(spark, sf_dir):
    """Multiple-choice items from parts; a seeded fifth is the support split."""
    return table(spark, sf_dir, "part").select(
        "p_partkey",
        F.col("p_brand").alias("subject"),
        F.concat(F.lit("Which kind is "), "p_name", F.lit("?")).alias("question"),
        F.col("p_type").alias("a"),
        F.col("p_brand").alias("b"),
        F.col("p_size").cast("string").alias("c"),
        F.col("p_name").alias("d"),
        F.substring(F.lit("ABCD"), (F.col("p_partkey") % 4 + 1).cast("int"), F.lit(1)).alias("answer"),
        (sampling.uniform("p_partkey", seed="dev") < 0.2).alias("is_dev"),
    )


@query(
    "choice_prompts",
    "PRJ29 JOIN10",
    with_ctes(
        "mc",
        f""", dev AS (SELECT subject, {_MCQ} AS text, answer, row_number() OVER (PARTITION BY subject ORDER BY {sql_hash("p_partkey::VARCHAR", "shot")}, p_partkey) - 1 AS slot,
  count(*) OVER (PARTITION BY subject) AS n FROM mc WHERE is_dev),
t AS (SELECT p_partkey, mc.subject, {_MCQ} AS text, answer, {sql_hash("p_partkey::VARCHAR", "shot-start")} % n AS st, n FROM mc JOIN (SELECT DISTINCT subject, n FROM dev) s ON s.subject = mc.subject WHERE NOT is_dev),
j AS (SELECT p_partkey, t.subject, t.text AS target, t.answer, shot, dev.text AS sup, dev.answer AS sup_answer FROM t CROSS JOIN generate_series(0, {SHOTS - 1}) g(shot)
  JOIN dev ON dev.subject = t.subject AND dev.slot = (t.st + shot) % t.n WHERE shot < least({SHOTS}, t.n))
SELECT p_partkey, answer, md5({q(prompts.CHOICE_SYSTEM["en"])[:-1].replace("{subject}", "' || subject || '") + "'"} || string_agg(sup || chr(10) || sup_answer || chr(10), '' ORDER BY shot) || target) AS prompt_md5
FROM j GROUP BY p_partkey, subject, target, answer""",
    ),
)
def choice_prompts(spark, sf_dir):
    items = choice_items(spark, sf_dir)
    items = items.select(
        "p_partkey", "subject", "answer", "is_dev", prompts.choice_question("question", ["a", "b", "c", "d"]).alias("text")
    )
    support = items.where("is_dev").select(
        F.col("p_partkey").alias("dev_key"), "subject", F.col("text").alias("sup"), F.col("answer").alias("sup_answer")
    )
    joined = R.support_sets(
        items.where(~F.col("is_dev")).drop("is_dev"), support, "subject", "p_partkey", "dev_key", SHOTS, "shot"
    )
    shots = F.transform(
        F.array_sort(F.collect_list(F.struct("shot", "sup", "sup_answer"))),
        lambda s: F.concat(s["sup"], F.lit("\n"), s["sup_answer"], F.lit("\n")),
    )
    system = prompts.fill(prompts.CHOICE_SYSTEM["en"], {"{subject}": F.col("subject")})
    whole = joined.groupBy("p_partkey", "subject", "text", "answer").agg(F.array_join(shots, "").alias("shots"))
    return whole.select("p_partkey", "answer", F.md5(F.concat(system, "shots", "text")).alias("prompt_md5"))


@query(
    "choice_prompts_zh",
    "PRJ29",
    with_ctes(
        "mc",
        f"""SELECT p_partkey, {q(prompts.CHOICE_SYSTEM["zh"])[:-1].replace("{subject}", "' || subject || '") + "'"} || {_MCQ.replace("chr(10) || 'Answer: '", "chr(10) || " + q(prompts.CHOICE_ANSWER["zh"].lstrip()))} AS prompt FROM mc""",
    ),
)
def choice_prompts_zh(spark, sf_dir):
    """The question on its own in the second language's wording."""
    system = prompts.fill(prompts.CHOICE_SYSTEM["zh"], {"{subject}": F.col("subject")})
    text = prompts.choice_question("question", ["a", "b", "c", "d"], "zh")
    return choice_items(spark, sf_dir).select("p_partkey", F.concat(system, text).alias("prompt"))


@query(
    "leak_free_descriptions",
    "PRJ30",
    with_ctes(
        "pred",
        f""", g AS (SELECT conv_id, turn, label, list_filter(list_transform(string_split(label, chr(10)), lambda s: {SQL_STRIP.format("s")}), lambda s: length(s) > 20) AS lines,
  regexp_replace(substr({SQL_STRIP.format("label || ' and so on'")}, 1, length(label)), '\\s+$', '') AS t FROM pred)
SELECT conv_id, turn, md5(list_reduce(list_concat([t], lines), lambda acc, s: replace(acc, s, ''))) AS text_md5 FROM g""",
    ),
)
def leak_free_descriptions(spark, sf_dir):
    out = R.leak_free_description(
        F.concat("prompt", "label", F.lit(" and so on")), "prompt", "label", "label", ["<|endoftext|>"]
    )
    return predictions(spark, sf_dir).select("conv_id", "turn", F.md5(out).alias("text_md5"))


@query(
    "description_candidates",
    "PRJ31",
    with_ctes(
        "prob",
        """SELECT p_partkey, (k - 1)::INTEGER AS candidate, p_brand || '-' || k AS description, question FROM prob, generate_series(1, 3) g(k)
WHERE p_partkey % 5 <> 4 AND k <= p_size % 3 + 1""",
    ),
)
def description_candidates(spark, sf_dir):
    lists = problems(spark, sf_dir).select("p_partkey", F.from_json("solutions", "array<string>").alias("d"))
    candidates = lists.select("p_partkey", F.posexplode("d").alias("candidate", "description"))
    return problems(spark, sf_dir).select("p_partkey", "question").join(candidates, "p_partkey").where("description is not null")


@query(
    "code_to_text_pairs",
    "PRJ32",
    with_ctes(
        "pred",
        f"""SELECT conv_id, turn, {SQL_STRIP.format("prompt")} || label AS code, CASE WHEN turn = 0 THEN -100 ELSE turn::INTEGER END AS first_label FROM pred""",
    ),
)
def code_to_text_pairs(spark, sf_dir):
    code = R.without_docstring(F.concat(F.lit(" "), "prompt", F.lit('\n"""docs"""'), "label"))
    labels = R.ignore_padding(F.array(F.col("turn").cast("int")))
    return predictions(spark, sf_dir).select("conv_id", "turn", code.alias("code"), F.get(labels, F.lit(0)).alias("first_label"))
