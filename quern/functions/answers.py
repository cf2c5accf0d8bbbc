"""Reading model answers: fenced blocks, routing JSON, placeholders, follow-up rewriting."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.functions import pandas_udf

FENCE = r"(?s)```([A-Za-z0-9_+-]*)[ \t]*\n(.*?)```"
#: Fence labels by the kind of output, words that point back.
KINDS = {"chart": "chart", "mermaid": "diagram", "diagram": "diagram", "form": "form", "action": "action", "table": "table", "json": "data"}
POINTING = r"(?i)\b(it|this|that|these|those|they|them|he|she|him|her|his|their)\b"


def blocks(text: Column) -> Column:
    """array<struct<kind,label,body>>: fenced blocks by label; other labels are code, pipe lines outside are a table."""
    labels, bodies = (F.regexp_extract_all(text, F.lit(FENCE), F.lit(i)) for i in (1, 2))
    table = F.create_map(*(F.lit(x) for kv in KINDS.items() for x in kv))
    fenced = F.zip_with(labels, bodies, lambda n, b: F.struct(F.coalesce(table[F.lower(n)], F.lit("code")).alias("kind"), F.lower(n).alias("label"), F.rtrim(b).alias("body")))
    rest = F.trim(F.regexp_replace(text, FENCE, ""))
    kind = F.when(F.size(F.regexp_extract_all(rest, F.lit(r"(?m)^.*\|.*\|.*$"), F.lit(0))) >= 2, "table").otherwise("text")
    return F.when(rest == "", fenced).otherwise(F.concat(fenced, F.array(F.struct(kind.alias("kind"), F.lit("").alias("label"), rest.alias("body")))))


#: Kinds of charts.
CHARTS = frozenset(["bar", "line", "pie", "scatter", "area", "radar", "doughnut", "bubble"])
_CHART = re.compile(r"chart\s*(?=\{)")
_JSON_PART = re.compile(r'"(?:[^"\\]|\\.)*"|[{}]|"', re.S)


def object_end(text: str, at: int) -> int | None:
    """Where the JSON object that begins at ``at`` ends; braces within strings do not count.  None if it does not end."""
    depth = 0
    for m in _JSON_PART.finditer(text, at):
        depth += {"{": 1, "}": -1}.get(m[0], 0)
        if m[0] == '"':
            return None  # a string that is not closed
        if not depth:
            return m.end()
    return None


def is_chart(body: str) -> bool:
    """A JSON object with type, title, labels and datasets of numbers."""
    try:
        x = json.loads(body)
        data = x["data"]
        sets = all(isinstance(d["label"], str) and all(isinstance(v, (int, float)) and not isinstance(v, bool) for v in d["data"]) for d in data["datasets"])
        return str(x["type"]).lower() in CHARTS and isinstance(x["title"], str) and all(isinstance(v, str) for v in data["labels"]) and sets
    except (ValueError, KeyError, TypeError, RecursionError):
        return False


def _chart_spans(text: str | None) -> list[tuple]:
    """(start, stop, kind, body) over the whole text, in order."""
    text, out, at, seek = text or "", [], 0, 0
    while m := _CHART.search(text, seek):
        end = object_end(text, m.end())
        if end is None or not is_chart(text[m.end() : end]):
            seek = m.end()
            continue
        if at < m.start():
            out.append((at, m.start(), "text", text[at : m.start()]))
        out.append((m.start(), end, "chart", text[m.end() : end]))
        at = seek = end
    return out + [(at, len(text), "text", text[at:])] * (at < len(text))


def loose_charts(text: Column) -> Column:
    """array<struct<start,stop,kind,body>>: charts that stand in the text as ``chart {...}`` without a fence, and the text between them.

    What only looks like a chart stays text.
    """
    return pandas_udf(lambda texts: pd.Series([_chart_spans(t) for t in texts]), "array<struct<start:int,stop:int,kind:string,body:string>>")(text)


def artifacts(text: Column, lines: int = 5) -> Column:
    """Code blocks of more than ``lines`` lines."""
    return F.filter(blocks(text), lambda b: (b["kind"] == "code") & (F.size(F.split(b["body"], "\n")) > lines))


def router(text: Column) -> Column:
    """struct(intent, query, confidence) of a model's JSON, which may stand in prose or a fence; nulls where it lacks a field."""
    body = F.regexp_extract(text, r"(?s)(\{.*\})", 1)
    j = F.from_json(body, "intent string, query string, confidence double")
    loose = lambda n: F.nullif(F.regexp_extract(text, rf'"{n}"\s*:\s*"([^"]*)"', 1), F.lit(""))
    return F.struct(F.coalesce(j["intent"], loose("intent")).alias("intent"), F.coalesce(j["query"], loose("query")).alias("query"), F.coalesce(j["confidence"], F.regexp_extract(text, r'"confidence"\s*:\s*([0-9.]+)', 1).try_cast("double")).alias("confidence"))


def substitute(template: Column, params: Column) -> Column:
    """{{name}} replaced from a map; unknown names stay."""
    return F.aggregate(F.map_entries(params), template, lambda t, e: F.replace(t, F.concat(F.lit("{{"), e["key"], F.lit("}}")), F.coalesce(e["value"], F.lit(""))))


def holds(condition: Column, params: Column) -> Column:
    """``a == b`` over parameters and literals, or a parameter that is true."""
    left, right = F.trim(F.split_part(condition, F.lit("=="), F.lit(1))), F.trim(F.split_part(condition, F.lit("=="), F.lit(2)))
    value = lambda x: F.coalesce(params[x], F.regexp_replace(x, "^[\"']|[\"']$", ""))
    return F.when(condition.contains("=="), value(left) == value(right)).otherwise(F.coalesce(params[F.trim(condition)] == "true", F.lit(False)))


#: Fixed values of follow-up rewriting: bare commands; pronouns in the order they are tried; words that point to a file
#: or else the entity; beginnings of a follow-up with what they stand for.
BARE_COMMANDS = ["search online", "google", "search web", "look up online", "find online", "search internet", "web search", "search the web", "check online", "look online"]
PRONOUNS = [" her ", " his ", " their ", " she ", " he ", " they ", "her ", "his "]
DEMONSTRATIVES = [" it ", " this ", " that ", " it?", " this?", " that?"]
ELLIPSES = [("and the ", "what is {topic} "), ("and ", ""), ("what about ", "what is {topic} "), ("how about ", "what is {topic} "), ("tell me more", "tell me more about {topic}"), ("more about", "more about {topic}"), ("more details", "more details about {topic}"), ("elaborate", "elaborate on {topic}"), ("explain", "explain {topic}")]


def _let(value: Column, body) -> Column:
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _first_replaced(text: Column, words: list[str], name: Column) -> Column:
    """``text`` with the first of ``words`` that it holds, in any case, replaced once by ``name`` in its place; null if it holds none."""
    out = F.lit(None).cast("string")
    for w in reversed(words):
        core = w.strip(" ?")
        at = F.instr(F.lower(text), w)
        new = F.concat(F.substring(text, F.lit(1), at - 1), F.lit(w[: w.index(core)]), name, F.lit(w[w.index(core) + len(core) :]), F.substring(text, at + len(w), F.length(text)))
        out = F.when(at > 0, new).otherwise(out)
    return out


def rewrite_in_context(query: Column, entity: Column, file: Column, topic: Column, concepts: Column, last_query: Column) -> Column:
    """A follow-up made self-contained from its conversation.

    In turn: a bare command takes the last query; a pronoun becomes the entity;
    a demonstrative the file under discussion or else the entity; a follow-up of at
    most five words without either is spelled out with the entity or topic; one or
    two words with nothing of that take the entity or three concepts.
    """
    # Each step's text is bound to a lambda's variable, so that later steps do not repeat its expression.
    trimmed = F.trim(query)
    low = F.lower(trimmed)
    n = F.size(F.filter(F.split(query, r"\s+"), lambda w: w != ""))
    is_bare = low.isin(BARE_COMMANDS)
    for c in BARE_COMMANDS:
        is_bare = is_bare | low.startswith(f"{c} ")
    bare = is_bare & last_query.isNotNull()
    about = F.coalesce(entity, topic, F.lit(""))
    ellipsis = F.lit(None).cast("string")
    for begin, long in reversed(ELLIPSES):
        rest = F.substring(query, F.lit(len(begin) + 1), F.length(query))
        spelled = F.concat(F.lit(long.split("{topic}")[0]), about, F.lit(long.split("{topic}")[1]), rest) if long else F.concat(about, F.lit(" "), F.trim(rest))
        ellipsis = F.when(low.startswith(begin), spelled).otherwise(ellipsis)
    target = F.coalesce(file, entity)

    def unresolved(said: Column) -> Column:
        def short(spelled: Column) -> Column:
            few = (n <= 2) & ~bare & spelled.isNull() & (low != "")
            more = F.when(few & entity.isNotNull(), F.concat(entity, F.lit(" "), trimmed)).when(few & (F.size(concepts) > 0), F.concat(trimmed, F.lit(" "), F.array_join(F.slice(concepts, 1, 3), " ")))
            return F.coalesce(spelled, more, said)

        return _let(F.when((n <= 5) & (about != ""), ellipsis), short)

    def pointing(said: Column, named: Column) -> Column:
        by_pointing = F.when(target.isNotNull(), _first_replaced(F.coalesce(named, said), DEMONSTRATIVES, target))
        return _let(by_pointing, lambda pointed: F.when(named.isNotNull() | pointed.isNotNull(), F.coalesce(pointed, named)).otherwise(unresolved(said)))

    first = F.when(bare, F.concat(trimmed, F.lit(" "), F.trim(last_query))).otherwise(query)
    return _let(first, lambda said: _let(F.when(entity.isNotNull(), _first_replaced(said, PRONOUNS, entity)), lambda named: pointing(said, named)))


def rewrite_with(query: Column, prompt: Column, generate, rule_based: Column) -> Column:
    """The answer of ``generate`` (a Column function or pandas UDF of the prompt), or the rule-based form where it is empty."""
    return F.coalesce(F.nullif(F.trim(generate(prompt)), F.lit("")), rule_based, query)


def rewrite_follow_up(query: Column, topic: Column) -> Column:
    """``rewrite_in_context`` where only a topic is known."""
    none = F.lit(None).cast("string")
    known = F.nullif(topic, F.lit(""))
    return rewrite_in_context(query, known, none, none, F.array().cast("array<string>"), none)


def entities(text: Column) -> Column:
    """Names of two or more capitalised words that do not begin with a sentence starter."""
    found = F.regexp_extract_all(text, F.lit(r"[A-Z][A-Za-z]+(?: [A-Z][A-Za-z]+)+"), F.lit(0))
    return F.array_distinct(F.transform(found, lambda x: F.regexp_replace(x, r"^(?:The|This|That|These|Those|What|When|Where|Which|Who|How|Why|And|But|For|In|On|At|If|Is|Are|Can|Please) ", "")))


def json_schema(title: Column, fields: Column) -> Column:
    """A form's array<struct<name,type,required>> as a JSON schema."""
    props = F.map_from_entries(F.transform(fields, lambda f: F.struct(f["name"], F.struct(f["type"].alias("type")))))
    return F.to_json(F.struct(F.lit("object").alias("type"), title.alias("title"), props.alias("properties"), F.transform(F.filter(fields, lambda f: f["required"]), lambda f: f["name"]).alias("required")))
