"""Generated text: citation markers, refusals, error kinds, JSON salvage, message budgets."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from marginalia.functions import text as X, vocabulary as V

MARKER = r"\[\^(-?[0-9]+)\^\]"
MESSAGE_BUDGET = 200_000
MESSAGE_FLOOR = 300


def _marker_numbers(answer: Column) -> Column:
    digits = F.regexp_extract_all(answer, F.lit(MARKER), F.lit(1))
    # Numbers beyond 18 digits are out of any range.
    return F.transform(digits, lambda d: F.when(F.length(d) <= 18, d.cast("bigint")).otherwise(F.lit(-1)))


def marker_report(answer: Column, n_chunks: Column) -> Column:
    """``struct(total, valid, removed, verified)`` of the ``[^n^]`` markers."""
    numbers = _marker_numbers(answer)
    valid = F.size(F.filter(numbers, lambda n: (n >= 1) & (n <= n_chunks)))
    return F.struct(F.size(numbers).alias("total"), valid.alias("valid"),
                    (F.size(numbers) - valid).alias("removed"), (F.size(numbers) == valid).alias("verified"))


def renumber_markers(answer: Column, n_chunks: Column, offset: Column, pattern: str = MARKER) -> Column:
    """Keep markers 1..n, shifted by ``offset``; drop the others, leaving the sentence."""
    between = F.split(answer, pattern)
    numbers = _marker_numbers(answer)
    kept = F.transform(numbers, lambda n: F.when(
        (n >= 1) & (n <= n_chunks), F.concat(F.lit("[^"), (n + offset).cast("string"), F.lit("^]"))).otherwise(""))
    parts = F.transform(between, lambda p, i: F.concat(p, F.coalesce(F.get(kept, i), F.lit(""))))
    return F.array_join(parts, "")


def clean_markers(answer: Column, n_chunks: Column) -> Column:
    """Answer without markers outside 1..n; kept markers stay as written."""
    between = F.split(answer, MARKER)
    whole = F.regexp_extract_all(answer, F.lit(MARKER), F.lit(0))
    numbers = _marker_numbers(answer)
    kept = F.transform(F.arrays_zip(whole.alias("w"), numbers.alias("n")), lambda z: F.when(
        (z["n"] >= 1) & (z["n"] <= n_chunks), z["w"]).otherwise(""))
    return F.array_join(F.transform(between, lambda p, i: F.concat(p, F.coalesce(F.get(kept, i), F.lit("")))), "")


def chunk_citations(answer: Column) -> Column:
    """Explicit ``[p1_c2]`` ids, distinct, in order of appearance."""
    return F.array_distinct(F.regexp_extract_all(
        F.coalesce(answer, F.lit("")), F.lit(r"(?U)\[(p\d+_c-?\d+)\]"), F.lit(1)))


def error_kind(answer: Column) -> Column:
    """``empty_response``, ``llm_error_response`` or NULL."""
    text = X.strip(F.coalesce(answer, F.lit("")))
    return (F.when(F.length(text) == 0, "empty_response")
            .when(F.startswith(text, F.lit(V.GENERATOR_ERROR_PREFIX)), "llm_error_response"))


def is_refusal(answer: Column) -> Column:
    return X.contains_any(F.coalesce(answer, F.lit("")), V.REFUSAL_PHRASES)


def needs_online(query: Column) -> Column:
    return X.contains_any(F.lower(query), V.ONLINE_WORDS)


def needs_external(query: Column) -> Column:
    return X.contains_any(F.lower(F.coalesce(query, F.lit(""))), V.EXTERNAL_WORDS)


def salvage_json(response: Column) -> Column:
    """JSON text between the first opening and the last closing bracket, code fence removed; NULL
    when there is none or it does not parse."""
    fenced = lambda text: F.regexp_extract(text, r"(?s)```(?:json)?\s*(.*?)```", 1)
    body = lambda text: F.when(text.rlike(r"(?s)```(?:json)?\s*.*?```"), X.strip(fenced(text))).otherwise(text)
    cut = lambda text: X.truthy(F.regexp_extract(body(text), r"(?s)[{\[].*[}\]]", 0))
    found = X.let(X.strip(F.coalesce(response, F.lit(""))), cut)
    return X.let(found, lambda json: F.when(F.try_parse_json(json).isNotNull(), json))


def payload_items(json_text: Column, item: str) -> Column:
    """Items of a salvaged payload: the top array, ``items``, or the first array value of the object."""
    array = f"ARRAY<{item}>"

    def first(json):
        keys = F.json_object_keys(F.when(F.startswith(json, F.lit("{")), json))
        values = F.from_json(json, "MAP<STRING,STRING>")
        arrays = X.let(values, lambda v: F.filter(F.transform(keys, lambda k: F.element_at(v, k)), lambda x: F.startswith(F.ltrim(x), F.lit("["))))
        return F.from_json(F.get(arrays, F.lit(0)), array)

    def listed(json):
        return F.when(F.startswith(json, F.lit("[")), F.from_json(json, array)).otherwise(X.let(
            F.get_json_object(json, "$.items"), lambda named: F.when(F.startswith(F.ltrim(named), F.lit("[")), F.from_json(named, array)).otherwise(first(json))))
    return F.filter(F.coalesce(X.let(json_text, listed), F.array().cast(array)), lambda x: x.isNotNull())


def sub_questions(raw: Column) -> Column:
    """At most five non-blank strings of a list or of ``questions``/``sub_questions``; NULL is an error."""
    usable = F.when(~F.startswith(raw, F.lit(V.GENERATOR_ERROR_PREFIX)) & F.try_parse_json(raw).isNotNull(), raw)
    top = F.when(F.startswith(F.ltrim(usable), F.lit("[")), usable)
    named = F.coalesce(_non_empty_array(F.get_json_object(usable, "$.questions")),
                       _non_empty_array(F.get_json_object(usable, "$.sub_questions")))
    # Variant elements keep their JSON type, so numbers and objects are told from strings.
    elements = F.from_json(F.coalesce(top, named), "ARRAY<VARIANT>")
    texts = F.transform(elements, lambda v: F.when(F.schema_of_variant(v) == "STRING",
                                                   X.strip(F.try_variant_get(v, "$", "string"))))
    kept = F.slice(F.filter(texts, lambda t: F.length(t) > 0), 1, 5)
    return F.when(F.size(kept) > 0, kept)


def _non_empty_array(json_text: Column) -> Column:
    return F.when(F.coalesce(F.json_array_length(json_text), F.lit(0)) > 0, json_text)


def fit_messages(messages: Column, budget: int = MESSAGE_BUDGET) -> Column:
    """An ``array<struct<role,content>>`` fitted into ``budget`` characters.

    A list over the budget starts with its system messages, whole. The others give up their heads, the oldest first: an equal
    share of what is over at that moment, but never below 300 characters. If that is not enough only the last two of them stay.
    """
    def chars(m):
        return F.coalesce(F.length(m["content"]), F.lit(0))
    is_system = lambda m: F.coalesce(m["role"] == "system", F.lit(False))
    rest = F.filter(messages, lambda m: ~is_system(m))
    over = F.aggregate(messages, F.lit(0).cast("bigint"), lambda n, m: n + chars(m)) - F.lit(budget)

    def give_up(state, m):
        share = F.floor(state["over"] / F.size(rest))
        cut = F.when(state["over"] > 0, F.least(F.greatest(chars(m) - MESSAGE_FLOOR, F.lit(0)), share)).otherwise(0).cast("int")
        return F.struct((state["over"] - cut).alias("over"), F.array_append(state["cuts"], cut).alias("cuts"))
    start = F.struct(over.alias("over"), F.array().cast("array<int>").alias("cuts"))
    folded = F.aggregate(rest, start, give_up)
    shorter = F.zip_with(rest, folded["cuts"], lambda m, cut: F.struct(
        m["role"].alias("role"), F.substring(F.coalesce(m["content"], F.lit("")), cut + 1, F.lit(2 ** 31 - 1)).alias("content")))
    last_two = F.when((folded["over"] > 0) & (F.size(rest) > 2), F.slice(shorter, -2, 2)).otherwise(shorter)
    return F.when(over <= 0, messages).otherwise(F.concat(F.filter(messages, is_system), last_two))
