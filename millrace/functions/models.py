"""Interfaces of the steps that a language model does: prompts, batches of calls, and what is read from the replies.

A model is a function from prompts to replies; it is called by the batch on executors, and only strings go in and out.
Replies are read by column expressions that have a value for whatever a model says.
"""

from __future__ import annotations

import json
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import fixed, text


class Model(Protocol):
    def __call__(self, prompts: list[str]) -> list[str]: ...


def asked(rows: DataFrame, prompt: Column, model: Model, to: str = "reply", size: int = 64) -> DataFrame:
    """rows with the model's reply to each prompt; null prompts are not sent and have no reply."""
    kept = rows.drop(to)
    schema = T.StructType([*kept.schema.fields, T.StructField(to, T.StringType())])

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, size):
                some = batch.slice(lo, size)
                prompts = some.column(some.num_columns - 1).to_pylist()
                sent = [p for p in prompts if p is not None]
                replies = iter(model(sent) if sent else [])
                said = [None if p is None else next(replies) for p in prompts]
                yield pa.RecordBatch.from_arrays([*some.columns[:-1], pa.array(said, pa.string())], names=schema.names)

    return kept.select("*", prompt.alias("__prompt")).mapInArrow(run, schema)


def classification_prompt(collection: str, query: Column, glossary: dict | None = None) -> Column:
    """Asks for the type, numbers, scenario and parts of a question about a collection."""
    kinds = ", ".join(fixed.QUERY_TYPES)
    known = f"Write out abbreviations by this glossary, and keep them too: {json.dumps(glossary, ensure_ascii=False, sort_keys=True)}\n" if glossary else ""
    head = f"A question about the documents of \"{collection}\" is to be put into one class of: {kinds}.\nSplit a question that needs several searches into two or three.\nGive numbers with a letter before them both with and without it.\n{known}Reply with JSON alone: query_type, rule_numbers, scenario, sub_queries.\n\nQuestion: "
    return F.concat(F.lit(head), query)


def answer_prompt(collection: str, query: Column, context: Column) -> Column:
    """Asks for an answer from the given documents only."""
    head = f"Answer a question about \"{collection}\" from these documents only. Name the source of each statement in brackets. Later versions and amendments prevail; say so where they do. Say if the documents do not answer it. First think within <thinking> and </thinking>.\n\nDocuments:\n"
    return F.concat(F.lit(head), context, F.lit("\n\nQuestion: "), query)


def document_prompt(collection: str, file: Column, title: Column) -> Column:
    kinds = ", ".join(fixed.PRIORITIES)
    return F.concat(F.lit(f"A document of \"{collection}\" is to be put into one class of: {kinds}.\nReply with JSON alone: doc_type, priority (1 to 9), description.\n\nFile: "), file, F.lit("\nBeginning:\n"), F.substring(title, 1, 800))


def judge_prompt(query: Column, answer: Column, context: Column) -> Column:
    asks = "\n".join(f"{a}: Yes or No" for a in fixed.ASPECTS)
    return F.concat(F.lit(f"Judge an answer by its documents. Reply with these lines:\n{asks}\n\nQuestion: "), query, F.lit("\nAnswer: "), answer, F.lit("\nDocuments:\n"), context)


def ontology_prompt(context: Column) -> Column:
    return F.concat(F.lit("Which attributes, grids and collections describe the entities of these documents? Reply with JSON alone: attributes, grids, collections, each a list of names.\n\n"), context)


def query_class(reply: Column) -> Column:
    """query_type, rule_numbers, scenario and sub_queries of a reply; an unknown type, or no JSON, is a concept."""
    found = F.from_json(text.json_object(reply), "query_type string, rule_numbers array<string>, scenario string, sub_queries array<string>")
    none = F.array().cast("array<string>")
    kind = F.when(found["query_type"].isin(fixed.QUERY_TYPES), found["query_type"]).otherwise("concept")
    return F.struct(kind.alias("query_type"), F.coalesce(found["rule_numbers"], none).alias("rule_numbers"), F.when(found["scenario"] != "", found["scenario"]).alias("scenario"), F.coalesce(found["sub_queries"], none).alias("sub_queries"))


def document_class(reply: Column) -> Column:
    """doc_type and priority of a reply; unknown and 9 without JSON, the type's own priority without one."""
    found = F.from_json(text.json_object(reply, "flat"), "doc_type string, priority int")
    kind = F.coalesce(found["doc_type"], F.lit("unknown"))
    defaults = F.create_map(*(F.lit(x) for p in fixed.PRIORITIES.items() for x in p))
    return F.struct(kind.alias("doc_type"), F.coalesce(found["priority"], defaults[kind], F.lit(9)).alias("priority"))


def glossary(reply: Column, candidates: Column) -> Column:
    """Acronyms and meanings of a reply; if it has no JSON, those of the candidates, `ACR: meaning` each."""
    said = F.from_json(text.json_object(reply), "map<string,string>")
    own = F.map_from_entries(F.transform(candidates, lambda c: F.struct(F.split_part(c, F.lit(": "), F.lit(1)).alias("k"), F.split_part(c, F.lit(": "), F.lit(2)).alias("v"))))
    return F.when(F.size(said) > 0, said).otherwise(own)


_NAMES = "attributes array<string>, grids array<string>, collections array<string>"


def ontology(reply: Column) -> Column:
    """The names in a reply; null without JSON."""
    return F.from_json(text.json_object(reply), _NAMES)


def odd_names(entity: Column, known: Column) -> Column:
    """Names in an entity (attributes, grids, collections as maps of JSON) that an ontology does not have: what was read
    from a picture is checked so."""
    parts = F.from_json(entity, "attributes map<string,string>, grids map<string,string>, collections map<string,string>")
    return F.array_sort(F.concat(*(F.array_except(F.coalesce(F.map_keys(parts[p]), F.array().cast("array<string>")), F.coalesce(known[p], F.array().cast("array<string>"))) for p in ("attributes", "grids", "collections"))))


def verdicts(reply: Column) -> Column:
    """Yes or No for each aspect of a judge's reply."""
    return F.struct(*(text.verdict(F.coalesce(reply, F.lit("")), a).alias(a) for a in fixed.ASPECTS))


def grade(reply: Column, kinds: tuple[str, ...] = ("EXACT", "FAITHFUL", "CITED", "FAIL")) -> Column:
    """The first of the grades that a reply names, by their order; the last if it names none."""
    low = F.upper(F.coalesce(reply, F.lit("")))
    found = F.lit(kinds[-1])
    for k in reversed(kinds[:-1]):
        found = F.when(low.contains(k), k).otherwise(found)
    return found


def first_source(prompts: list[str]) -> list[str]:
    """A stand-in for a model that answers: the first line of the documents, and where it is from."""
    out = []
    for p in prompts:
        lines = [x for x in p.partition("Documents:\n")[2].split("\n") if x.strip()]
        out.append(f"{lines[0]} [1]" if lines else "The documents do not answer it.")
    return out


def lenient_judge(prompts: list[str]) -> list[str]:
    """A stand-in for a judge: an answer is faithful if it is in the documents, relevant if it shares a long word with
    the question, and cited if it has brackets."""
    out = []
    for p in prompts:
        question, _, rest = p.partition("Question: ")[2].partition("\nAnswer: ")
        answer, _, documents = rest.partition("\nDocuments:\n")
        bare = answer.split(" [")[0]
        words = {w for w in question.lower().split() if len(w) > 3}
        says = (bare in documents, bool(words & set(answer.lower().split())), "[" in answer)
        out.append("\n".join(f"{a}: {'Yes' if ok else 'No'}" for a, ok in zip(fixed.ASPECTS, says)))
    return out
