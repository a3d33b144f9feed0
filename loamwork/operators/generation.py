"""Planning, prompting, judging and refining generated questions; model calls are injected functions."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.greedy import cut
from ..functions.sampling import apportion, pinned
from . import models

#: Characters that a regeneration prompt quotes of a question and of an answer.
QUESTION_CHARS, ANSWER_CHARS = 420, 520


def plan_batch(target: dict[str, int], accepted: dict[str, int], weights: dict[str, float], size: int) -> dict[str, int]:
    """How many tasks of each type come next (QAF-03).

    By largest remainder of the weights, no more than a type still needs; what
    that leaves over goes to the types with room, by their room.
    """
    room = {t: max(0, n - accepted.get(t, 0)) for t, n in target.items()}
    size = min(size, sum(room.values()))
    weights = {t: w for t, w in weights.items() if t in room} or dict.fromkeys(room, 1.0)
    out = {t: min(n, room[t]) for t, n in apportion(weights, size).items()}
    while sum(out.values()) < size:
        free = {t: float(room[t] - out[t]) for t in out if room[t] > out[t]}
        if not free:
            break
        for t, n in apportion(free, min(size - sum(out.values()), int(sum(free.values())))).items():
            out[t] += n
    return out


def next_tasks(spark: SparkSession, seeds: DataFrame, *, counts: dict[str, int], modes: dict[str, float], hops: dict[str, float], iteration: int, seed: int = 42) -> DataFrame:
    """Tasks of a batch: task_id, qa_type, hops, mode, seed_id (QAF-03).  seeds: id.

    Modes and hop counts of multi-hop tasks follow what is still wanted of
    each, in pinned order.  Seeds are taken in pinned order and again from the
    start if they are too few; without any they are named fallback.  The plan
    is as long as the batch; the seeds are cut to that by a top-n.
    """
    n, multi = sum(counts.values()), counts.get("multi_hop", 0)
    spread = lambda w: [k for k, c in sorted(apportion(w, multi).items()) for _ in range(c)]
    mixed = lambda xs, salt: [x for _, x in sorted((_pin(seed + iteration, salt, i), x) for i, x in enumerate(xs))]
    mode, hop = mixed(spread(modes), "mode"), mixed(spread(hops), "hop")
    rows = [("lookup", 1, "")] * (n - multi) + [("multi_hop", int(hop[i]) if i < len(hop) else 2, mode[i] if i < len(mode) else "factual") for i in range(multi)]
    tasks = spark.createDataFrame([(i, f"iter_{iteration}_{i:05d}", *r) for i, r in enumerate(rows)], "n int, task_id string, qa_type string, hops int, mode string")
    few = seeds.select(F.col("id").cast("string").alias("seed_id")).orderBy(pinned(seed + iteration, F.col("id")), "id").limit(n)
    few = few.withColumn("k", F.row_number().over(Window.orderBy(pinned(seed + iteration, F.col("seed_id")), "seed_id")) - 1)
    found = few.agg(F.count("*").alias("found"))
    placed = tasks.join(F.broadcast(found)).withColumn("k", F.when(F.col("found") > 0, F.col("n") % F.col("found")))
    named = placed.join(few, "k", "left").withColumn("seed_id", F.coalesce("seed_id", F.concat(F.lit("fallback_"), F.col("n").cast("string"))))
    return named.select("task_id", "qa_type", "hops", "mode", "seed_id")


def _pin(*parts: object) -> str:
    import hashlib

    return hashlib.md5("|".join(map(str, parts)).encode()).hexdigest()


_MARK = re.compile(r"\[\[\s*if\s+(\w+)\s*\]\]|\[\[\s*endif\s*\]\]")
_FIELD = re.compile(r"\{\{|\}\}|\{(\w+)\}")


def template(text: str, variables: dict[str, Column]) -> Column:
    """A template as a column: {x}, {{ and }}, and [[if x]] ... [[endif]], nested (QAF-04).

    The template is read once, when the plan is made; rows only see a
    concatenation.  A block stays where its variable is neither null, blank nor
    an empty list.  Unknown variables and unbalanced marks are errors.
    """

    def plain(piece: str) -> list[Column]:
        out, at = [], 0
        for m in _FIELD.finditer(piece):
            out.append(F.lit(piece[at : m.start()]))
            if m[1] is None:
                out.append(F.lit(m[0][0]))
            elif m[1] in variables:
                out.append(F.coalesce(variables[m[1]].cast("string"), F.lit("")))
            else:
                raise KeyError(f"no template variable {m[1]}")
            at = m.end()
        return [*out, F.lit(piece[at:])]

    stack: list[tuple[str | None, list[Column]]] = [(None, [])]
    at = 0
    for m in _MARK.finditer(text):
        stack[-1][1].extend(plain(text[at : m.start()]))
        at = m.end()
        if m[1]:
            stack.append((m[1], []))
            continue
        if len(stack) == 1:
            raise ValueError("[[endif]] without [[if]]")
        name, parts = stack.pop()
        given = F.trim(F.coalesce(variables[name].cast("string"), F.lit(""))) if name in variables else F.lit("")
        stack[-1][1].append(F.when(~given.isin("", "[]", "{}"), F.concat(*parts)).otherwise(""))
    if len(stack) > 1:
        raise ValueError("[[if]] without [[endif]]")
    return F.concat(*stack[0][1], *plain(text[at:]))


def prepare(tasks: DataFrame, links: DataFrame) -> DataFrame:
    """Tasks with the seed that they keep: seed_id, found, qa_type, hops (QAF-05).

    tasks: task_id, qa_type, hops, seeds (the seed and its alternatives, in
    order); links: seed_id, found (secondaries of a seed).  A multi-hop task
    takes its first seed, of it and three more, that has secondaries; it becomes
    a lookup of its own seed if none has, and its hops follow what is found.
    """
    tried = tasks.select("*", F.posexplode(F.slice("seeds", 1, 4)).alias("at", "seed_id")).join(links, "seed_id", "left").withColumn("found", F.coalesce("found", F.lit(0)))
    own = F.struct((F.col("at") > 0).alias("other"), "at", "seed_id", F.lit(0).alias("found"))
    good = F.when((F.col("hops") > 1) & (F.col("found") > 0), F.struct("at", "seed_id", "found"))
    best = tried.groupBy("task_id", "qa_type", "hops").agg(F.min(good).alias("g"), F.min(own).alias("o"))
    linked = F.col("g").isNotNull()
    return best.select(
        "task_id", F.when((F.col("hops") > 1) & ~linked, "lookup").otherwise(F.col("qa_type")).alias("qa_type"),
        F.when(linked, F.least("hops", F.col("g.found") + 1)).otherwise(1).alias("hops"), F.coalesce("g.seed_id", "o.seed_id").alias("seed_id"), F.coalesce("g.found", F.lit(0)).alias("found"),
    )


def generate(rows: DataFrame, prompt: str, ask: Callable[[str], str]) -> DataFrame:
    """Question and answer of a model for each row's prompt; null where it fails or cannot be read (QAF-06)."""
    asked = cut(models.call(rows, prompt, ask))
    return asked.withColumn("qa", models.parse_qa(F.col("response"))).select("*", "qa.question", "qa.answer").drop("qa")


def reference_id(content: Column, hash_: Column, metadata: Column) -> Column:
    """hash, else id, file or document_id of the metadata, else the first 80 characters (QAF-39)."""
    given = [F.nullif(metadata[k], F.lit("")) for k in ("id", "file", "document_id")]
    return F.coalesce(F.nullif(hash_, F.lit("")), *given, F.substring(content, 1, 80))


def qa_row(question: Column, answer: Column, qa_type: Column, hops: Column, references: Column) -> Column:
    """A generated question as a row with the fields that filters fill later (QAF-39)."""
    none = lambda kind: F.lit(None).cast(kind)
    return F.struct(
        question.alias("question"), answer.alias("answer"), references.alias("reference_chunks"), qa_type.alias("qa_type"), hops.alias("min_hop_count"), none("boolean").alias("is_co_located"),
        none("string").alias("filter_status"), none("string").alias("filter_reasoning"), none("string").alias("no_context_answer"), F.create_map().cast("map<string,double>").alias("eval_scores"),
    )


def answer_text(text: Column) -> Column:
    """What stands in the answer tag, else all of it (QAF-48)."""
    plain = F.trim(F.coalesce(text, F.lit("")))
    return F.when(plain.rlike(r"(?is)<answer>.*?</answer>"), F.trim(F.regexp_extract(plain, r"(?is)<answer>(.*?)</answer>", 1))).otherwise(plain)


def tool_uses(messages: str) -> Column:
    """Blocks of kind tool_use in the messages of a rollout, a JSON list (QAF-48)."""
    blocks = "coalesce(try_variant_get(m, '$.content', 'array<variant>'), cast(array() AS array<variant>))"
    uses = f"size(filter({blocks}, b -> coalesce(try_variant_get(b, '$.type', 'string') = 'tool_use', false)))"
    return F.expr(f"aggregate(coalesce(try_variant_get(try_parse_json({messages}), '$', 'array<variant>'), cast(array() AS array<variant>)), 0, (s, m) -> s + {uses})")


def equivalence(answer: Column, candidate: Column) -> Column:
    """struct(equivalent, confidence, reasoning) of a judge's JSON; nothing without a candidate (QAF-48)."""
    yes = F.lower(F.coalesce(F.get_json_object(answer, "$.is_equivalent"), F.lit("false"))) == "true"
    sure = F.coalesce(F.get_json_object(answer, "$.confidence").try_cast("double"), F.lit(0.0))
    bad = F.coalesce(F.try_parse_json(answer).isNull(), F.lit(True))
    case = lambda value, empty, broken: F.when(candidate == "", empty).when(bad, broken).otherwise(value)
    return F.struct(
        case(yes, F.lit(False), F.lit(False)).alias("equivalent"), case(sure, F.lit(0.0), F.lit(0.0)).alias("confidence"),
        case(F.trim(F.coalesce(F.get_json_object(answer, "$.reasoning"), F.lit(""))), F.lit("No candidate answer."), F.lit("parse_error")).alias("reasoning"),
    )


def rollout_verdict(question: Column, equivalent: Column, calls: Column, hops: Column, refinements: Column, max_refinements: int = 2) -> Column:
    """struct(status, reason_code): passed if equivalent by enough tool calls, else refine while the budget lasts (QAF-19)."""
    code = F.when(F.trim(F.coalesce(question, F.lit(""))) == "", "missing_question").when(equivalent & (calls >= hops), "env_filter_passed").when(equivalent, "too_easy").otherwise("incorrect_or_unresolved")
    status = F.when(code == "env_filter_passed", "passed").when(code == "missing_question", "rejected").when(refinements < max_refinements, "needs_refinement").otherwise("rejected")
    return F.struct(status.alias("status"), code.alias("reason_code"))


def refine(items: DataFrame, judge: Callable[[DataFrame], DataFrame], regenerate: Callable[[DataFrame], DataFrame], max_rounds: int = 2) -> DataFrame:
    """Items with their last verdict and the rounds they took: ..., status, reason, rounds (QAF-22).

    judge adds status and reason to items; regenerate makes new items of those
    that need refinement.  What still needs it after *max_rounds* is rejected.
    Each round is written before the next reads it, so models are asked once.
    """
    columns, left = items.columns, items
    done: DataFrame | None = None
    for n in range(max_rounds + 1):
        judged = cut(judge(left).select(*columns, "status", "reason").withColumn("rounds", F.lit(n)))
        again = judged.where("status = 'needs_refinement'")
        if n == max_rounds:
            judged = judged.withColumn("reason", F.when(F.col("status") == "needs_refinement", "refinement_budget_exhausted").otherwise(F.col("reason")))
            judged = judged.withColumn("status", F.when(F.col("status") == "needs_refinement", "rejected").otherwise(F.col("status")))
            return judged if done is None else done.union(judged)
        own = judged.where("status <> 'needs_refinement'")
        done = own if done is None else done.union(own)
        left = cut(regenerate(again.select(*columns)).select(*columns))
        if left.isEmpty():
            return done
    raise AssertionError


def rejected(verdict: Column, reason: Column, code: Column) -> Column:
    """A rejection that keeps the verdict before it under original names (QAF-36).  verdict: status, reason, reasoning, metadata."""
    return F.struct(
        F.lit("rejected").alias("status"), reason.alias("reason"), reason.alias("reasoning"),
        F.struct(
            F.lit("pipeline").alias("filter_mode"), code.alias("reason_code"), verdict["status"].alias("original_filter_status"), verdict["reason"].alias("original_filter_reason"),
            verdict["reasoning"].alias("original_filter_reasoning"), verdict["metadata"].alias("original_filter_metadata"),
        ).alias("metadata"),
    )


def short(text: Column, chars: int) -> Column:
    plain = F.trim(F.coalesce(text, F.lit("")))
    return F.when(F.length(plain) > chars, F.concat(F.substring(plain, 1, chars - 3), F.lit("..."))).otherwise(plain)


def regeneration_prompt(fields: dict[str, Column], switched: Column) -> Column:
    """What to do better, line by line; empty fields have no line (QAF-37).

    fields: task, attempt, code, failure, tag, overlap, action, reasoning, hint,
    judge_reasoning, evidence, old_seed, new_seed, question, answer.
    """
    line = lambda name, value: F.when(F.trim(F.coalesce(value, F.lit(""))) != "", F.concat(F.lit(f"- {name}: "), value))
    known = lambda c: F.coalesce(F.nullif(F.trim(c), F.lit("")), F.lit("unknown"))
    f = fields
    anchor = F.when(switched, F.concat(F.lit("switched seed chunk after repeated failures ("), f["old_seed"], F.lit(" -> "), f["new_seed"], F.lit(")"))).otherwise(F.concat(F.lit("keep same seed chunk ("), f["new_seed"], F.lit(")")))
    return F.concat_ws(
        "\n", F.lit("Regeneration instructions:"), line("source_task_id", f["task"]), line("attempt", f["attempt"]), line("previous_filter_reason_code", known(f["code"])), line("previous_failure_type", f["failure"]),
        line("previous_judge_reason_tag", known(f["tag"])), line("overlap_triggered", f["overlap"]), line("expected_action", f["action"]), line("previous_filter_reasoning", f["reasoning"]), line("previous_refinement_hint", f["hint"]),
        line("previous_judge_reasoning", f["judge_reasoning"]), line("overlapping_terms_that_caused_rejection", f["evidence"]), line("reanchor_action", anchor), F.lit("Previous QA to improve:"),
        F.concat(F.lit("- question: "), short(f["question"], QUESTION_CHARS)), F.concat(F.lit("- answer: "), short(f["answer"], ANSWER_CHARS)),
        F.lit("Rewrite the QA to address the failure reason while staying grounded in the provided primary/secondary chunks for this attempt."),
    )


def event(stage: str, kind: str, before: Column, after: Column, details: Column, code: Column | None = None) -> Column:
    """A journey event (QAF-47)."""
    return F.struct(F.lit(stage).alias("stage"), F.lit(kind).alias("event_type"), before.alias("qa_type_before"), after.alias("qa_type_after"), F.coalesce(code, F.lit("")).alias("reason_code") if code is not None else F.lit("").alias("reason_code"), F.to_json(details).alias("details"))


def record(events: Column, one: Column) -> Column:
    """The events and one more (QAF-47)."""
    return F.concat(F.coalesce(events, F.array().cast("array<struct<stage:string,event_type:string,qa_type_before:string,qa_type_after:string,reason_code:string,details:string>>")), F.array(one))


def transformed(question: Column, candidate: Column, style: Callable[[Column], Column]) -> Column:
    """struct(question, changed, style) after a transformer: a blank or failed candidate changes nothing (QAF-31)."""
    plain, new = F.trim(F.coalesce(question, F.lit(""))), F.trim(F.coalesce(candidate, F.lit("")))
    final = F.when(new == "", plain).otherwise(new)
    return F.struct(final.alias("question"), (final != plain).alias("changed"), style(final).alias("style"))


def transform_counts(rows: DataFrame) -> DataFrame:
    """One row of counters: processed, mutated, unchanged, errors (QAF-31).  rows: changed, failed."""
    return rows.agg(F.count("*").alias("processed"), F.count_if("changed").alias("mutated"), F.count_if(~F.col("changed")).alias("unchanged"), F.count_if("failed").alias("errors"))


def exported(rows: DataFrame) -> DataFrame:
    """Question rows with their events, metadata and the four parts of the verdict as columns (QAF-38).  rows: qa, events, metadata, verdict."""
    v = F.col("verdict")
    return rows.select("qa.*", F.col("events").alias("journey_events"), F.col("metadata").alias("generation_metadata"), v["status"].alias("status"), v["reason"].alias("reason"), v["reasoning"].alias("reasoning"), F.to_json(v["metadata"]).alias("verdict_metadata"))


def load_config(given: dict, bounds: dict[str, tuple[float, float]], removed: tuple[str, ...] = ()) -> dict:
    """A configuration with numbers held to their bounds and single texts as lists where the key is a plural (QAF-45).

    A bound's type is the setting's; removed keys are errors.
    """
    gone = sorted(set(given) & set(removed))
    if gone:
        raise ValueError(f"settings no longer known: {', '.join(gone)}")
    out = {}
    for key, value in given.items():
        if key in bounds:
            low, high = bounds[key]
            value = type(low)(max(low, min(high, type(low)(value))))
        elif key.endswith("s") and isinstance(value, str):
            value = [v.strip() for v in value.split(",") if v.strip()]
        out[key] = value
    return out


def rubric_prompt(rubric: dict[str, Column], question: Column, truth: Column, response: Column) -> Column:
    """What a judge is asked about one response and one rubric: title, description, scores (RUB-01)."""
    known = F.when(F.trim(F.coalesce(truth, F.lit(""))) != "", F.concat(F.lit("Reference: "), F.trim(truth), F.lit("\n"))).otherwise("")
    scale = F.when(F.size(rubric["scores"]) > 0, F.concat(F.lit("Allowed scores: "), F.array_join(rubric["scores"], ", "))).otherwise("Answer 1 if it holds, else 0.")
    return F.concat(F.lit("Rubric: "), rubric["title"], F.lit("\n"), rubric["description"], F.lit("\nQuestion: "), question, F.lit("\n"), known, F.lit("Response: "), response, F.lit("\n"), scale)


def rubric_score(answer: Column, scores: Column) -> Column:
    """The score of a judge's JSON, or its nearest allowed one; 0 if it cannot be read (RUB-01).  scores: array<double>, empty for 0 and 1."""
    given = F.get_json_object(F.regexp_extract(models.without_fences(answer), r"(?s)(\{.*\})", 1), "$.score").try_cast("double")
    near = F.array_min(F.transform(scores, lambda s: F.struct(F.abs(s - given).alias("gap"), s.alias("s"))))["s"]
    return F.coalesce(F.when(F.size(scores) > 0, near).otherwise(F.when(given >= 0.5, 1.0).when(given.isNotNull(), 0.0)), F.lit(0.0))


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """A cache table with newer rows in place of older ones (RUB-05); write it to a new path and switch to that."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def adaptive_rubrics(questions: DataFrame, ask: Callable[[str], str]) -> DataFrame:
    """Rubrics that a model makes for a question: question_id, kind, title, description (RUB-06).  questions: question_id, prompt.

    The answer is JSON with lists of positive and negative rubrics; what cannot
    be read gives none.  Retention by the spread of their scores is RUB-02.
    """
    asked = cut(models.call(questions, "prompt", ask))
    body = F.regexp_extract(models.without_fences(F.col("response")), r"(?s)(\{.*\})", 1)
    kind = "array<struct<title:string,description:string>>"
    both = F.from_json(body, f"struct<positive_rubrics:{kind},negative_rubrics:{kind}>")
    parts = [asked.select("question_id", F.lit(k).alias("kind"), F.inline(both[f"{k}_rubrics"])) for k in ("positive", "negative")]
    return parts[0].union(parts[1]).where("trim(coalesce(title, '')) <> ''")


def judge_pair(correctness: Column, conciseness: Column, response: Column) -> Column:
    """struct(correctness, conciseness), held to 0 and 1; noughts for a blank response or a failed call (RWD-09)."""
    ok = (F.trim(F.coalesce(response, F.lit(""))) != "") & correctness.isNotNull() & conciseness.isNotNull()
    clip = lambda c: F.when(ok, F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))).otherwise(0.0)
    return F.struct(clip(correctness).alias("correctness"), clip(conciseness).alias("conciseness"))


def environment_rows(examples: DataFrame, system: str) -> DataFrame:
    """Examples as an environment reads them: prompt (messages as JSON), ground_truth, reference_chunks (RWD-08)."""
    message = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    prompt = F.to_json(F.array(message("system", F.lit(system)), message("user", F.coalesce("question", F.lit("")))))
    return examples.select("id", prompt.alias("prompt"), F.coalesce("answer", F.lit("")).alias("ground_truth"), F.to_json(F.coalesce("references", F.array().cast("array<string>"))).alias("reference_chunks"))


def page_prompts(clusters: DataFrame, chunks: DataFrame, most: int = 20, chars: int = 1000) -> DataFrame:
    """What a model is asked for a cluster's page: name, prompt (WIK-04).  clusters: name, id; chunks: id, file, text.

    Of each cluster *most* chunks, taken in turn from its files.
    """
    place = F.row_number().over(Window.partitionBy("name", "file").orderBy("id"))
    rows = clusters.join(chunks, "id").withColumn("round", place)
    rows = rows.withColumn("k", F.row_number().over(Window.partitionBy("name").orderBy("round", "id"))).where(F.col("k") <= most)
    line = F.struct("k", F.concat(F.lit("["), F.col("k").cast("string"), F.lit("] "), F.substring("text", 1, chars)).alias("t"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda s: s["t"]), "\n")
    return rows.groupBy("name").agg(body.alias("body")).select("name", F.concat(F.lit("Write a page about "), "name", F.lit(" from these texts:\n"), "body").alias("prompt"))


def summary_prompt(samples: DataFrame, context: str, chars: int = 800) -> DataFrame:
    """One row with the prompt for a corpus summary from sampled chunks (PRF-23).  samples: place, text; few by definition."""
    line = F.struct("place", F.concat(F.lit("---\n"), F.substring("text", 1, chars)).alias("t"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda s: s["t"]), "\n")
    return samples.agg(F.concat(F.lit(f"Context: {context}\nDescribe this corpus as JSON with summary and queries.\n"), body).alias("prompt"))


def parse_summary(answer: Column) -> Column:
    """struct(summary, queries) of a model's JSON; the plain text is the summary if it is no JSON (PRF-23)."""
    plain = models.without_fences(answer)
    body = F.regexp_extract(plain, r"(?s)(\{.*\})", 1)
    summary = F.coalesce(F.get_json_object(body, "$.summary"), F.when(F.try_parse_json(body).isNull(), plain), F.lit(""))
    return F.struct(F.trim(summary).alias("summary"), F.coalesce(F.from_json(F.get_json_object(body, "$.queries"), "array<string>"), F.array().cast("array<string>")).alias("queries"))


def ask_models(prompts: DataFrame, ask: dict[str, Callable[[str], str]], n: int = 1) -> DataFrame:
    """Answers of several models, n of each: id, model, attempt, response; failed calls have no row (LLM-02).  prompts: id, prompt."""
    if not ask:
        raise ValueError("no model to ask")
    out = None
    for name, call in sorted(ask.items()):
        rows = prompts.select("id", "prompt", F.lit(name).alias("model"), F.explode(F.sequence(F.lit(1), F.lit(n))).alias("attempt"))
        rows = models.call(rows, "prompt", call).where("response IS NOT NULL").drop("prompt")
        out = rows if out is None else out.union(rows)
    return out


def registry(clients: dict[str, list[str]], wanted: list[str] | None = None) -> list[str]:
    """The names of the models that the clients at hand offer, of those wanted, in that order; none is an error (LLM-04)."""
    offered = {m for models_ in clients.values() for m in models_}
    found = [m for m in (wanted if wanted is not None else sorted(offered)) if m in offered]
    if not found:
        raise ValueError(f"none of these models is offered: {wanted}")
    return found


def response_parts(payload: str) -> Column:
    """struct(answer, thinking, summary, tokens) of three shapes of API responses, as JSON (LLM-05)."""
    get = lambda path, kind="string": f"try_variant_get(v, '{path}', '{kind}')"
    blocks = f"coalesce({get('$.content', 'array<variant>')}, cast(array() AS array<variant>))"
    of = lambda kind, field: f"element_at(transform(filter({blocks}, b -> coalesce(try_variant_get(b, '$.type', 'string') = '{kind}', false)), b -> try_variant_get(b, '$.{field}', 'string')), -1)"
    refusal = f"CASE WHEN {get('$.choices[0].message.refusal')} IS NOT NULL THEN concat('[REFUSAL]: ', {get('$.choices[0].message.refusal')}) END"
    answer = f"coalesce(try({of('text', 'text')}), nullif({get('$.choices[0].message.content')}, ''), {refusal}, {get('$.output_text')}, '')"
    tokens = f"coalesce({get('$.usage.input_tokens', 'bigint')}, {get('$.usage.prompt_tokens', 'bigint')}, 0L) + coalesce({get('$.usage.output_tokens', 'bigint')}, {get('$.usage.completion_tokens', 'bigint')}, 0L)"
    body = f"named_struct('answer', {answer}, 'thinking', coalesce({of('thinking', 'thinking')}, {get('$.choices[0].message.reasoning_content')}), 'summary', {get('$.reasoning.summary')}, 'tokens', {tokens})".replace(f"try({of('text', 'text')})", of("text", "text"))
    safe = body.replace("element_at(", "try_element_at(")
    return F.expr(f"get(transform(array(try_parse_json({payload})), v -> {safe}), 0)")


def with_retries(ask: Callable[..., str], *, attempts: int = 3, delay: float = 0.0, retryable: Callable[[Exception], bool] = lambda e: True, **limits: int) -> Callable[[str], str]:
    """A call that is tried again after errors worth it, and without a limit that the model says it does not know (LLM-06)."""

    def call(prompt: str) -> str:
        import time

        given = dict(limits)
        for n in range(1, attempts + 1):
            try:
                return ask(prompt, **given)
            except Exception as e:
                text = str(e).lower()
                unknown = [k for k in sorted(given, key=len, reverse=True) if "unsupported parameter" in text and re.search(rf"\b{re.escape(k)}\b", text)]
                if unknown:
                    del given[unknown[0]]
                elif n == attempts or not retryable(e):
                    raise
                elif delay:
                    time.sleep(delay * n)
        return ask(prompt, **given)

    return call
