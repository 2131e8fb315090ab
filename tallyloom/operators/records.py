"""Instruction records: parsing, prompts, distillation, sampling, packing, mixing.

A record is a row with ``fields MAP<STRING, STRING>`` and an explicit ordinal; positions are taken once,
when a file is read, and never assumed after a shuffle.
"""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from itertools import chain

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from tallyloom.functions import checks, prompts, sampling
from tallyloom.functions import text as X
from tallyloom.operators import ordering as O
from tallyloom.session import known_small

# --- parsing -----------------------------------------------------------------------------------


def _field(fields, name) -> Column:
    return F.try_element_at(fields, F.lit(name))


def _has(fields, *names) -> Column:
    out = F.lit(True)
    for n in names:
        out = out & F.map_contains_key(fields, F.lit(n))
    return out


def parse_example(fields, order: str = "instruction") -> Column:
    """STRUCT(prompt, response) of a record with optional keys.

    ``order`` is the layout looked for first: ``instruction`` (which also knows response and input/output)
    or ``question``.
    """
    fields = X.col(fields)
    empty = F.lit("")

    def get(name, *others):
        return F.coalesce(*[F.when(_has(fields, n), _field(fields, n)) for n in (name, *others)], empty)

    def pair(prompt, response):
        return F.struct(prompt.alias("prompt"), response.alias("response"))

    extra = get("input")
    instructed = F.when(extra != "", F.concat(get("instruction"), F.lit("\n"), extra)).otherwise(get("instruction"))
    instruction = get("instruction")
    problem = F.when(instruction != "", F.concat(instruction, F.lit("\n"), get("prompt"))).otherwise(get("prompt"))
    layouts = {
        "instruction_output": (_has(fields, "instruction", "output"), pair(instructed, get("output"))),
        "instruction_response": (_has(fields, "instruction", "response"), pair(instructed, get("response"))),
        "question": (_has(fields, "question", "answer"), pair(get("question"), get("answer"))),
        "goal": (_has(fields, "goal", "target"), pair(get("goal"), get("target"))),
        "problem": (
            _has(fields, "prompt") & (_has(fields, "canonical_solution") | _has(fields, "buggy_solution")),
            pair(problem, get("canonical_solution", "output")),
        ),
        "input_output": (_has(fields, "input", "output"), pair(get("input"), get("output"))),
    }
    orders = {
        "instruction": ("instruction_output", "instruction_response", "question", "goal", "problem", "input_output"),
        "question": ("question", "goal", "problem", "instruction_output"),
    }
    result = pair(get("text", "input"), get("label", "response"))
    for name in reversed(orders[order]):
        condition, value = layouts[name]
        result = F.when(condition, value).otherwise(result)
    return result


def usable(prompt, response) -> Column:
    """Both sides present and the joined text at least two tokens long."""
    joined = F.concat_ws("\n", X.col(prompt), X.col(response))
    return ~X.blank(prompt) & ~X.blank(response) & (X.word_count(joined) >= 2)


def keep_usable(records: DataFrame, keys: Sequence[str], prompt: str, response: str) -> tuple[DataFrame, DataFrame]:
    """The usable records, and per key how many were kept and skipped."""
    marked = records.withColumn("__ok", usable(prompt, response))
    counts = marked.groupBy(*keys).agg(F.count_if("__ok").alias("kept"), F.count_if(~F.col("__ok")).alias("skipped"))
    return marked.where("__ok").drop("__ok"), counts


def meta_value(fields, keys: Sequence[str], default: Column) -> Column:
    fields = X.col(fields)
    return X.first_non_blank(*[_field(fields, k) for k in keys], default=default)


def length_features(prompt: str, response: str) -> list[Column]:
    return [
        F.length(prompt).alias("input_chars"),
        F.length(response).alias("output_chars"),
        X.word_count(prompt).alias("input_words"),
        X.word_count(response).alias("output_words"),
    ]


# fixed values: keys that hold answer-like text
TEXT_KEYS = ("output", "answer", "response", "completion", "text", "content", "final", "target")
CHAT_KEYS = ("conversations", "conversation", "messages", "dialog", "chat")
NESTED_KEYS = ("answer", "output", "text", "content")


#: steps of a path beside field names: each item of a list, objects among an object's values
ITEMS, INNER = "[*]", "{*}"
LEAST_REMARK = 20  # fixed value: a text longer than this counts where nothing else is found

#: where texts lie below an object, in the order they are listed; a tuple stands for alternatives at one item
ANSWER_PATHS = (
    *((key,) for key in TEXT_KEYS),
    ("choices", ITEMS, (("text",), ("message", "content"), ("delta", "content"))),
    *((key,) for key in CHAT_KEYS),
    (INNER, tuple((key,) for key in NESTED_KEYS)),
)


def _steps(node, step) -> list:
    """Nodes one step below a node."""
    if step == ITEMS:
        return list(node) if isinstance(node, list) else []
    if step == INNER:
        return [v for v in node.values() if isinstance(v, dict)]
    return [node[step]] if isinstance(node, dict) and node.get(step) else []


def _reached(node, path) -> list:
    """Nodes at the end of a path; an item that alternatives do not apply to stands for itself."""
    nodes = [node]
    for step in path:
        if isinstance(step, tuple):
            nodes = [
                found
                for n in nodes
                for found in (chain.from_iterable(_reached(n, way) for way in step) if isinstance(n, dict) else (n,))
            ]
        else:
            nodes = [below for n in nodes for below in _steps(n, step)]
    return nodes


def _branches(root) -> dict[int, list]:
    """What is listed of each list and object that is reached, by identity; nothing where no text lies below.

    Every node is looked at once, the nodes below it first, so that an object knows whether it has to fall back on its
    remarks without walking what lies below again.
    """
    below: dict[int, list] = {}
    waiting = [(root, False)]
    while waiting:
        node, seen_below = waiting.pop()
        if not isinstance(node, (list, dict)):
            continue
        if not seen_below:
            if id(node) not in below:
                found = node if isinstance(node, list) else list(chain.from_iterable(_reached(node, p) for p in ANSWER_PATHS))
                below[id(node)] = found
                waiting.append((node, True))
                waiting += [(n, False) for n in found]
            continue
        told = [n for n in below[id(node)] if (n.strip() if isinstance(n, str) else below.get(id(n)))]
        if not told and isinstance(node, dict):
            told = [v for v in node.values() if isinstance(v, str) and len(v.strip()) > LEAST_REMARK]
        below[id(node)] = told
    return below


def _listed(root) -> list[str]:
    """Texts below a parsed record, depth first along the paths; only nodes with a text below are entered."""
    below = _branches(root)
    out, waiting = [], [root]
    while waiting:
        node = waiting.pop()
        if isinstance(node, str):
            out += [node.strip()] if node.strip() else []
        else:
            waiting += reversed(below.get(id(node), ()))
    return out


def answer_texts(records) -> Column:
    """All answer-like texts of a nested JSON record; an unreadable record, or one nested too deep to parse, has none.

    The work is linear in the record and in what it lists (a text that several paths reach is listed for each).
    """

    @F.arrow_udf(ArrayType(StringType()))
    def extract(batch: pa.Array) -> pa.Array:
        out = []
        for raw in batch.to_pylist():
            try:
                out.append(_listed(json.loads(raw)))
            except (TypeError, ValueError, RecursionError):
                out.append([])
        return pa.array(out, pa.list_(pa.string()))

    return extract(X.col(records))


# --- selection and sampling --------------------------------------------------------------------


def ordinal_slice(rows: DataFrame, ordinal: str, start: int = 0, limit: int | None = None) -> DataFrame:
    """Rows start .. start + limit - 1 by ordinal; first-N truncation is start 0."""
    kept = F.col(ordinal) >= start
    return rows.where(kept if limit is None else kept & (F.col(ordinal) < start + limit))


def sampled_fraction(rows: DataFrame, keys: Sequence[str], ids: Sequence[str], ratio: float, seed: str, flag: str) -> DataFrame:
    """Marks int(ratio * n) rows per key, chosen without replacement in seeded hash order."""
    hashed = rows.withColumn("__h", sampling.hash_int(*ids, seed=seed))
    ranked = O.positions(hashed, keys, ["__h", *ids], "__pos", total="__n")
    return ranked.withColumn(flag, F.col("__pos") < F.floor(F.col("__n") * F.lit(ratio))).drop("__h", "__pos", "__n")


def flip_noisy_labels(rows: DataFrame, ids: Sequence[str], label: str, ratio: float, seed: str = "noise") -> DataFrame:
    """Binary labels flipped on a sampled fraction; ``is_noisy`` marks the flipped rows."""
    marked = sampled_fraction(rows, [], ids, ratio, seed, "is_noisy")
    return marked.withColumn(label, F.when(F.col("is_noisy"), 1 - F.col(label)).otherwise(F.col(label)))


def sample_both_splits(
    train: DataFrame, validation: DataFrame, ids: Sequence[str], train_share: float, validation_share: float, seed: str = "cap"
) -> tuple[DataFrame, DataFrame]:
    """A seeded share of either split, the same at every size; a row decides by its own hash."""
    u = sampling.uniform(*ids, seed=seed)
    return train.where(u < train_share), validation.where(u < validation_share)


def hash_split(rows: DataFrame, ids: Sequence[str], bounds: Mapping[str, float], seed: str, name: str = "split") -> DataFrame:
    """A split name per row by seeded hash; ``bounds`` are upper ends of the unit interval, ascending."""
    u = sampling.uniform(*ids, seed=seed)
    out = F.lit(list(bounds)[-1])
    for split, upper in reversed(list(bounds.items())[:-1]):
        out = F.when(u < upper, split).otherwise(out)
    return rows.withColumn(name, out)


def class_ids(rows: DataFrame, label: str, name: str = "label_id") -> DataFrame:
    """0-based class id in label order; classes are numbered in their own table, however many there are."""
    numbered = O.positions(rows.select(label).where(F.col(label).isNotNull()).distinct(), [], [label], name)
    return rows.join(numbered.withColumn(name, F.col(name).cast("int")), label)


# --- distillation ------------------------------------------------------------------------------


def answer_keys(pairs: DataFrame, dataset: str, ordinal: str, fields: str, label: str) -> DataFrame:
    """(dataset, answer_key): the first field of the record with ordinal 0 that contains the label."""
    matching = F.filter(F.map_entries(F.col(fields)), lambda e: F.contains(e["value"], F.col(label)))
    return pairs.where(F.col(ordinal) == 0).select(dataset, F.get(matching, F.lit(0))["key"].alias("answer_key"))


def distill(records: DataFrame, predictions: DataFrame, dataset: str = "dataset", ordinal: str = "ordinal") -> DataFrame:
    """(dataset, ordinal, fields, answer_key, replaced): predictions that pass become the answers.

    Record i meets prediction i, the shorter side decides the length. A prediction replaces the answer
    when it carries no banned phrase and passes the check of its dataset, otherwise the original stays.
    """
    clean = {"fields": X.strip_fields("fields"), "label": X.strip("label"), "predict": X.strip("predict")}
    answers = predictions.select(dataset, ordinal, "label", "predict")
    pairs = records.join(answers, [dataset, ordinal]).withColumns(clean)
    # only the records with ordinal 0 are read for the keys
    first = records.where(F.col(ordinal) == 0).join(answers.where(F.col(ordinal) == 0), [dataset, ordinal]).withColumns(clean)
    keyed = pairs.join(known_small(answer_keys(first, dataset, ordinal, "fields", "label")), dataset)
    key = F.when(F.col("answer_key").isNotNull(), F.col("answer_key")).otherwise(
        F.raise_error(F.concat(F.lit("no field holds the label in "), F.col(dataset))).cast("string")
    )
    keyed = keyed.withColumn("answer_key", key).withColumn(
        "replaced", checks.acceptable("predict") & checks.check_for(dataset, "label", "predict")
    )
    swap = F.transform_values(
        "fields", lambda k, v: F.when(F.col("replaced") & (k == F.col("answer_key")), F.col("predict")).otherwise(v)
    )
    return keyed.select(dataset, ordinal, swap.alias("fields"), "answer_key", "replaced")


def answer_differences(original: DataFrame, distilled: DataFrame, keys: Sequence[str], ordinal: str, answer: str) -> DataFrame:
    """(keys, ordinal, position, differs): 1-based position and whether the stripped answers differ."""
    other = distilled.select(*keys, ordinal, X.strip(answer).alias("__b"))
    return original.join(other, [*keys, ordinal]).select(
        *keys, ordinal, (F.col(ordinal) + 1).alias("position"), (~X.strip(answer).eqNullSafe(F.col("__b"))).alias("differs")
    )


def difference_rate(compared: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, total, differing, diff_pct): diff_pct = (1 - match rate) * 100."""
    return compared.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if("differs").alias("differing"),
        (F.avg(F.col("differs").cast("int")) * 100).alias("diff_pct"),
    )


# --- prompts from tables -------------------------------------------------------------------------


def shot_prefix(examples: DataFrame, order: str, shots: int, rendered: Column, sep: str = "") -> DataFrame:
    """One row ``prefix``: the first ``shots`` examples rendered one after the other."""
    chosen = examples.orderBy(order).limit(shots).select(order, rendered.alias("__t"))
    texts = F.transform(F.array_sort(F.collect_list(F.struct(order, "__t"))), lambda s: s["__t"])
    return chosen.agg(F.array_join(texts, sep).alias("prefix"))


def with_prefix(rows: DataFrame, prefix: DataFrame) -> DataFrame:
    """The single-row prefix on every row (an equi join on a constant, one row on the right)."""
    return rows.withColumn("__k", F.lit(1)).join(prefix.withColumn("__k", F.lit(1)), "__k").drop("__k")


def support_sets(
    targets: DataFrame, support: DataFrame, group: str, target_id: str, support_id: str, shots: int, seed: str
) -> DataFrame:
    """(target columns, shot, support columns): min(shots, available) random support rows per target.

    Support rows stand in a seeded order per group; a target takes consecutive ones from a random start,
    wrapping around. A target therefore joins exactly the rows it uses, never its whole group.
    """
    hashed = support.withColumn("__h", sampling.hash_int(support_id, seed=seed))
    placed = O.positions(hashed, [group], ["__h", support_id], "__slot").drop("__h")
    sizes = support.groupBy(group).agg(F.count(F.lit(1)).alias("__n"))
    wanted = targets.join(sizes, group).withColumn("__start", sampling.hash_int(target_id, seed=seed + "-start") % F.col("__n"))
    last = F.least(F.lit(shots).cast("bigint"), F.col("__n")) - 1
    wanted = wanted.withColumn("shot", F.explode(F.sequence(F.lit(0).cast("bigint"), last)))
    wanted = wanted.withColumn("__slot", (F.col("__start") + F.col("shot")) % F.col("__n")).drop("__start", "__n")
    return wanted.join(placed, [group, "__slot"]).drop("__slot")


def explode_solutions(problems: DataFrame, solutions: str, max_question_tokens: int, tokens: Column) -> tuple[DataFrame, DataFrame]:
    """One row per solution, and a one-row count of problems without readable solutions and of long ones.

    ``tokens`` is the length of the question prompt; a solution of a prompt at or over the limit is dropped.
    """
    parsed = problems.withColumn("__s", F.from_json(solutions, "array<string>")).withColumn("__t", tokens)
    parsed = parsed.withColumn("__bad", F.col("__s").isNull() | ~F.substring(F.ltrim(F.col(solutions)), 1, 1).eqNullSafe("["))
    long = F.col("__t") >= max_question_tokens
    counts = parsed.agg(
        F.count_if("__bad").alias("skipped_problems"),
        F.coalesce(F.sum(F.when(~F.col("__bad") & long, F.size("__s"))), F.lit(0)).cast("bigint").alias("skipped_long"),
    )
    kept = parsed.where(~F.col("__bad") & ~long)
    rows = kept.select(*[c for c in problems.columns if c != solutions], F.explode("__s").alias("solution"))
    return rows, counts


def remove_leaks(text, solution, min_length: int = 20) -> Column:
    """The text without any solution line longer than ``min_length`` that occurs in it."""
    lines = F.transform(F.split(X.col(solution), "\n"), X.strip)
    return F.aggregate(
        F.filter(lines, lambda line: F.length(line) > min_length), X.col(text), lambda acc, line: F.replace(acc, line)
    )


def leak_free_description(generation, prompt, docstring, solution, stops: Sequence[str]) -> Column:
    """Generated description cut to the docstring's length and at a stop word, with solution lines removed."""
    body = X.strip(F.substring(X.col(generation), F.length(X.col(prompt)) + 1, F.length(X.col(generation))))
    cut = F.substring(body, F.lit(1), F.length(X.col(docstring)))
    return remove_leaks(F.regexp_replace(X.before_first(cut, stops), r"\s+$", ""), solution)


def without_docstring(code) -> Column:
    """Pieces 0 and 2 of the triple-quote split, the first one stripped."""
    pieces = F.split(X.col(code), '"""', F.lit(-1))
    return F.concat(X.strip(F.get(pieces, F.lit(0))), F.get(pieces, F.lit(2)))


def ignore_padding(labels, pad: int = 0, ignore: int = -100) -> Column:
    return F.transform(X.col(labels), lambda t: F.when(t == pad, F.lit(ignore)).otherwise(t))


# --- post-processing of generations ---------------------------------------------------------------


def strip_prompt(generation, prompt) -> Column:
    return F.substring(X.col(generation), F.length(X.col(prompt)) + 1, F.length(X.col(generation)))


def continuation(generation, prompt, stops: Sequence[str]) -> Column:
    """Prompt followed by the generation up to its first stop string."""
    return F.concat(X.col(prompt), X.before_first(strip_prompt(generation, prompt), stops))


def first_answer_line(generation, mark: str) -> Column:
    """First line of what follows the first ``mark``."""
    piece = F.get(F.split(X.col(generation), F.lit("\\Q" + mark + "\\E"), F.lit(-1)), F.lit(1))
    return F.get(F.split(X.strip(piece), "\n"), F.lit(0))


def math_program(generation, shots: int, script: str) -> Column:
    """Program after the last solution header, without a following question, plus the closing script."""
    body = X.strip(X.after_nth(generation, "# solution in Python:", shots + 1))
    return F.concat(X.before_first(body, ["Q:"]), F.lit("\n" + script))


def completion_between(generation, starts: Sequence[str], stops: Sequence[str]) -> Column:
    out = X.col(generation)
    for start in starts:
        out = X.after_first(out, start)
    return X.strip(X.before_first(out, stops))


def unfenced(generation) -> Column:
    """Code of an answer: after the response mark, inside its python fence, without main guard and usage notes."""
    steps = [_inside_fence]
    for mark in ('if __name__ == "__main__":', "# Example usage"):
        steps.append(_stripped_before(mark))
    steps.append(_without_opening_line)
    out = X.before_first(F.replace(X.after_last(generation, "### Response:"), F.lit("\t"), F.lit("    ")), ["</s>"])
    for step in steps:
        out = X.bind(out, step)
    return out


def _stripped_before(mark: str):
    return lambda v: F.when(v.contains(mark), X.strip(X.before_first(v, [mark]))).otherwise(v)


def _inside_fence(answer) -> Column:
    body = F.replace(X.strip(X.after_first(answer, "```python")), F.lit("```python"), F.lit(""))
    inner = X.bind(body, lambda v: F.when(v.contains("```"), X.strip(X.before_first(v, ["```"]))).otherwise(v))
    return F.when(answer.contains("```python"), inner).otherwise(answer)


def _without_opening_line(answer) -> Column:
    return F.when(answer.startswith("Here's"), X.after_first(answer, "\n")).otherwise(answer)


# --- tags ------------------------------------------------------------------------------------------

KNOWN_EPOCHS = ("0", "1", "5")  # fixed values


def epoch_tag(c) -> Column:
    """``1``, ``epoch1`` and ``epoch_1`` to ``epoch_1`` for the known epochs, anything else unchanged."""
    c = X.strip(c)
    number = F.regexp_extract(c, r"^(?:epoch)?(\d+)$", 1)
    return F.when(number.isin(*KNOWN_EPOCHS), F.concat(F.lit("epoch_"), number)).otherwise(c)


def method_tags(c) -> Column:
    """Array of methods a token stands for: both, all and the pair itself mean both."""
    c = F.lower(X.strip(c))
    both = F.array(F.lit("sft"), F.lit("sdft"))
    return (
        F.when(c.isin("both", "all", "sft,sdft", "sdft,sft"), both)
        .when(c.isin("sft", "sdft"), F.array(c))
        .otherwise(F.array().cast("array<string>"))
    )


def unique_methods(tokens) -> Column:
    return F.array_distinct(F.flatten(F.transform(X.col(tokens), method_tags)))


# --- packing and mixing -----------------------------------------------------------------------------


def pack_bins(samples: DataFrame, ids: Sequence[str], tokens: str, max_tokens: int, shards: int, seed: str) -> DataFrame:
    """Adds (shard, bin): samples in seeded order, a new bin whenever ``max_tokens`` more tokens have started.

    A sample belongs to the bin its first token falls into, so a bin is filled until it reaches the limit
    and its last sample may run over, to be cut when the bin is written.
    """
    hashed = samples.withColumn("__h", sampling.hash_int(*ids, seed=seed))
    hashed = hashed.withColumn("shard", (F.col("__h") % F.lit(shards)).cast("int"))
    ranked = O.running_total(hashed, ["shard"], ["__h", *ids], weight=tokens, before="offset", total=None)
    return ranked.withColumn("bin", F.floor(F.col("offset") / F.lit(max_tokens))).drop("__h")


def packed_sequences(binned: DataFrame, question: str, answer: str, max_tokens: int, end: str) -> DataFrame:
    """(shard, bin, n_samples, input, labels): token arrays cut at ``max_tokens``; question labels are ignored.

    A bin holds at most ``max_tokens`` tokens and one sample more, which bounds the array it is collected in.
    """
    q, a = X.words(question), F.concat(X.words(answer), F.array(F.lit(end)))
    masked = F.concat(F.transform(q, lambda _: F.lit("-100")), a)
    rows = binned.select("shard", "bin", "offset", F.concat(q, a).alias("__in"), masked.alias("__lab"))
    whole = rows.groupBy("shard", "bin").agg(
        F.array_sort(F.collect_list(F.struct("offset", "__in", "__lab"))).alias("s"), F.count(F.lit(1)).alias("n_samples")
    )
    return whole.select(
        "shard",
        "bin",
        "n_samples",
        F.slice(F.flatten(F.transform("s", lambda x: x["__in"])), 1, max_tokens).alias("input"),
        F.slice(F.flatten(F.transform("s", lambda x: x["__lab"])), 1, max_tokens).alias("labels"),
    )


def interleave(
    rows: DataFrame, source: str, ids: Sequence[str], probabilities: Mapping[str, float], strategy: str, seed: str
) -> DataFrame:
    """Rows with a ``place`` on a common axis: rank within the source plus jitter, over its probability.

    ``under`` stops where the first source is used up, ``over`` goes on until all are, repeating the shorter
    ones; ``concat`` keeps every row once.
    """
    hashed = rows.withColumn("__h", sampling.hash_int(*ids, seed=seed))
    ranked = O.positions(hashed, [source], ["__h", *ids], "__rank", total="__n")
    p = F.lit(None).cast("double")
    for name, probability in probabilities.items():
        p = F.when(F.col(source) == name, F.lit(float(probability))).otherwise(p)
    ranked = ranked.withColumn("__p", p)
    if strategy == "concat":
        return ranked.withColumn("place", F.col("__rank").cast("double")).withColumn("copy", F.lit(0).cast("bigint")).drop("__h", "__rank", "__n", "__p")
    ends = ranked.groupBy(source).agg((F.max("__n") / F.max("__p")).alias("__end"))
    pick = F.min if strategy == "under" else F.max
    horizon = ends.agg(pick("__end").alias("__horizon")).withColumn("__k", F.lit(1))
    placed = ranked.withColumn("__k", F.lit(1)).join(horizon, "__k").drop("__k")
    copies = F.lit(0).cast("bigint")
    if strategy == "over":
        copies = F.greatest(F.lit(0).cast("bigint"), F.ceil(F.col("__horizon") * F.col("__p") / F.col("__n")) - 1)
    placed = placed.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("bigint"), copies)))
    jitter = sampling.uniform(*ids, "copy", seed=seed + "-place")
    at = (F.col("__rank") + F.col("copy") * F.col("__n") + jitter) / F.col("__p")
    return (
        placed.withColumn("place", at)
        .where(F.col("place") < F.col("__horizon"))
        .drop("__h", "__rank", "__n", "__p", "__horizon")
    )


# --- generated datasets ------------------------------------------------------------------------------


def transformation_dataset(phrases: DataFrame, phrase: str, ids: Sequence[str], test_last: int = 10) -> DataFrame:
    """(ids, variation, prompt, answer, text, split): every phrase under every sentence transform.

    The last ``test_last`` phrases in id order are the test split.
    """
    tests = phrases.orderBy(*[F.col(i).desc() for i in ids]).limit(test_last).select(*ids, F.lit("test").alias("split"))
    marked = phrases.select(*ids, phrase).join(tests, list(ids), "left")
    variants = F.array(
        *[F.struct(F.lit(name).alias("variation"), form(phrase).alias("answer")) for name, form in X.TRANSFORMS.items()]
    )
    rows = marked.select(*ids, phrase, F.coalesce("split", F.lit("train")).alias("split"), F.explode(variants).alias("v"))
    head = F.concat(
        F.lit("Bot is a chatbot that performs a specific transformation on sentences: "), F.col("v.variation"),
        F.lit("\n    For example:\n    "), F.col(phrase), F.lit(" -> "),
    )
    return rows.select(
        *ids, "split", "v.variation", head.alias("prompt"), "v.answer",
        F.concat(head, F.lit(" "), F.col("v.answer"), F.lit("</s>")).alias("text"),
    )


def math_dataset(draws: DataFrame, ids: Sequence[str], with_reason: bool = True, seed: str = "math") -> DataFrame:
    """(ids, variation, prompt, answer, [reason], text, split): every problem for every draw of four numbers.

    Numbers are seeded hashes in 1..99; nine draws in ten are for training.
    """
    names = list(prompts.MATH_PROBLEMS)
    rows = draws.select(*ids, F.explode(F.array(*[F.lit(n) for n in names])).alias("variation"))
    for letter in "abcd":
        rows = rows.withColumn(letter, sampling.hash_int("variation", *ids, seed=seed + letter) % 99 + 1)
    slots = {"{" + letter.upper() + "}": F.col(letter).cast("string") for letter in "abcd"}
    parts = prompts.MATH_PROBLEMS
    problem = prompts.by_name("variation", {n: prompts.fill(parts[n][0], slots) for n in names})
    reason = prompts.by_name("variation", {n: prompts.fill(parts[n][1], slots) for n in names})
    answer = F.lit(None).cast("bigint")
    for n in names:
        answer = F.when(F.col("variation") == n, F.expr(parts[n][2]).cast("bigint")).otherwise(answer)
    head = F.concat(F.lit("Solve the following math problem. "), problem, F.lit(" -> "))
    why = F.concat(F.lit("Reason: "), reason, F.lit(" ")) if with_reason else F.lit("")
    split = F.when(sampling.uniform(*ids, seed=seed + "-split") < 0.9, "train").otherwise("test")
    out = rows.select(*ids, "variation", split.alias("split"), head.alias("prompt"), answer.alias("answer"), reason.alias("reason"), why.alias("__why"))
    out = out.withColumn("text", F.concat("prompt", "__why", F.lit("Answer: "), F.col("answer").cast("string"), F.lit("</s>")))
    return out.drop("__why") if with_reason else out.drop("__why", "reason")
