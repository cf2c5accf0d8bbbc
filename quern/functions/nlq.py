"""Natural-language query analysis as Column expressions.

A rule is a list of conditions on the lower-cased query that all hold; a
condition is (kind, words) with kind any, none, all, starts or equals, or
(kind, number) for words_at_most, words_over, marks_over.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

# The phrases that decide an intent, in order of precedence.
GREETING = ["hello", "hi", "hey", "greetings", "good morning", "good afternoon", "good evening", "namaste", "thanks", "thank you", "bye", "goodbye"]
ACKNOWLEDGEMENT = ["ok", "okay", "yes", "no", "sure", "alright", "got it"]
META = ["what is your name", "who are you", "what can you do", "how do you work", "what are your capabilities", "what context do you have", "what do you know about me", "what have we discussed", "what information do you have", "tell me about yourself", "what are you", "what's your role"]
CLARIFICATION = ["what do you mean", "can you explain", "i don't understand", "clarify"]
TRANSFORM = ["show me", "display", "visualize", "format as", "convert to", "make it", "do the same", "repeat that", "do it again"]
CONTEXT_WORDS = ["the same", " that", " this", " those", " these", " it ", " them", " it."]
DOCUMENT_REFERENCES = ["from my", "from the", "from document", "from file", "based on my", "using my"]
CREATIVE = ["create fake", "create a fake", "make up", "invent", "imagine", "pretend", "fictional", "fabricate", "simulate", "mock up", "come up with", "brainstorm", "suggest some", "give me ideas", "make a flowchart", "make a diagram", "create a flowchart", "create a diagram", "draw a", "make a chart", "create a chart", "make an infographic"]
WRITE = ["write a", "write an", "draft a", "draft an", "compose a"]
EXAMPLES = ["example of", "give me an example", "show me an example", "sample data", "show me a sample", "random data", "test data", "mock data", "dummy data", "placeholder", "demo data", "fake data", "synthetic data", "for testing", "for demo"]
CALCULATION = ["calculate", "compute", "sum of", "average of", "multiply", "divide"]
NEWS = ["news", "breaking", "headline", "happening now", "what's new in", "what's happening", "announcement", "current events", "recent events"]
REAL_TIME = ["weather", "stock price", "live score", "right now", "currently", "at the moment", "real-time", "up-to-date", "search online", "google", "search web", "look up online", "find online", "search internet", "web search"]
FILTERED = [">", "<", "greater than", "less than", "more than", "exceeds", "below", "above"]
COMPARATIVE = ["compare", "difference between", "vs", "versus", "better than", "worse than", "similar to", "contrast"]
AGGREGATION = ["how many", "count", "total", "sum", "average", "mean", "list all", "show all"]
TEMPORAL = ["last year", "this year", "last month", "this month", "last week", "this week", "recent", "latest", "during"]
SEARCH = ["find", "search", "show me", "get me", "retrieve", "fetch", "locate", "look up", "pull up", "bring up"]
DEFINITION = ["what is", "what are", "define", "explain", "tell me about"]
DOCUMENT_TERMS = ["section", "clause", "provision", "article", "contract", "agreement", "document", "file", "paragraph", "page", "schedule", "annexure", "exhibit"]
RETRIEVE = ["find", "search", "show me", "get", "list", "what", "where", "when", "how", "why", "explain", "tell me about", "information", "details", "document", "file", "contract", "clause", "section", "provision", "requirement", "compliance", "audit", "liability", "payment", "terms"]
NO_RETRIEVE = ["hello", "hi", "hey", "thanks", "thank you", "bye", "goodbye", "ok", "okay", "yes", "no", "sure", "cool", "great"]
NO_RETRIEVE_META = ["what is your name", "who are you", "how are you", "what can you do", "what are you"]
CONTEXT_GREETING = ["hi", "hello", "hey", "thanks", "thank you", "bye", "goodbye"]
SIMPLE = ["can you", "are you", "do you", "will you", "what is your", "who are you", "how are you"]
SYSTEM = ["what am i working on", "what files", "what processes", "my system", "my computer", "my ram", "my cpu", "running processes", "active applications"]
CODE = ["explain this", "what does this do", "how does", "function", "class", "method", "code", "bug", "error", "implement", "refactor"]
AGENT_RUN = ["run it", "run the agent", "run agent", "execute", "use the agent", "use it", "use agent", "start the agent", "start agent"]
AGENT_CREATE = ["create an agent", "create a agent", "create agent", "make an agent", "make a agent", "make agent", "build an agent", "build a agent", "build agent", "i need an agent", "i need a agent", "generate an agent", "generate a agent", "generate agent", "new agent", "create a team", "create a crew", "build a team", "build a crew", "make a team", "make a crew", "assemble a team", "assemble a crew"]
CODE_VERBS = ["generate", "create", "write", "implement", "build"]
CODE_NOUNS = ["code", "function", "class", "method", "api", "endpoint", "component", "module", "script", "program", "algorithm", "struct", "interface", "trait", "type", "enum"]
#: Words that carry no search, and stand-ins for terms.
STOP_WORDS = "what is are was were the a an of in for to and or can you me my tell show find get do does how where when why who which about please could would should there their from with that this have has had be been being it its i".split()
SYNONYMS = [
    ("salary", "income compensation pay"), ("income", "salary earnings revenue"), ("address", "residence location"), ("phone", "mobile contact telephone"), ("email", "e-mail mail"), ("dob", "date of birth birthday"), ("date of birth", "dob birthday"),
    ("pan", "PAN permanent account number"), ("aadhar", "aadhaar UID unique identification"), ("aadhaar", "aadhar UID unique identification"), ("bank", "banking account financial"), ("balance", "amount total"), ("name", "full name"), ("spouse", "husband wife partner"),
    ("father", "parent dad"), ("mother", "parent mom"), ("children", "kids dependents"), ("employer", "company organization firm"), ("designation", "position title role job"), ("qualification", "education degree"), ("experience", "work history employment"),
]

#: Rules in order of precedence, with the words and numbers inside them.
INTENTS = [
    ("Greeting", [("words_at_most", 5), ("any", GREETING)]),
    ("SimpleAcknowledgment", [("words_at_most", 3), ("starts", ACKNOWLEDGEMENT)]),
    ("MetaQuestion", [("any", META)]),
    ("Clarification", [("words_at_most", 10), ("any", CLARIFICATION)]),
    ("FollowUpRequest", [("starts", TRANSFORM), ("any", CONTEXT_WORDS)]),
    ("CreativeGeneration", [("none", DOCUMENT_REFERENCES), ("any", CREATIVE)]),
    ("CreativeGeneration", [("none", DOCUMENT_REFERENCES), ("starts", WRITE), ("none", ["about my", "summary of"])]),
    ("ExampleCreation", [("any", EXAMPLES)]),
    ("Calculation", [("any", CALCULATION)]),
    ("Calculation", [("regex", r"\d+(\.\d+)?\s*[-+*/×÷^]\s*\d")]),
    ("CurrentEvents", [("none", ["document", "file", "my"]), ("any", NEWS)]),
    ("RealTimeInfo", [("any", REAL_TIME)]),
    ("FilteredSearch", [("any", FILTERED)]),
    ("FilteredSearch", [("all", ["where", "and"])]),
    ("FilteredSearch", [("all", ["with", "than"])]),
    ("ComparativeAnalysis", [("any", COMPARATIVE)]),
    ("AggregationQuery", [("any", AGGREGATION)]),
    ("TemporalQuery", [("regex", r"\b(19|20)\d{2}\b")]),
    ("TemporalQuery", [("any", TEMPORAL)]),
    ("MultiHopReasoning", [("all", [" if ", " then "])]),
    ("MultiHopReasoning", [("marks_over", 1)]),
    ("DocumentSearch", [("starts", SEARCH)]),
    ("DocumentSearch", [("any", [f" {w} " for w in SEARCH])]),
    ("DefinitionQuery", [("none", ["you"]), ("starts", DEFINITION), ("any", DOCUMENT_TERMS)]),
    ("GeneralKnowledge", [("none", ["you"]), ("starts", DEFINITION)]),
    ("FactualLookup", [("words_over", 3)]),
]
#: Rules in order of precedence, with the words and numbers inside them.
CONTEXTS = [
    ("Greeting", [("words_at_most", 5), ("any", CONTEXT_GREETING)]),
    ("SimpleQuestion", [("words_at_most", 10), ("any", SIMPLE)]),
    ("SystemQuery", [("any", SYSTEM)]),
    ("CodeAnalysis", [("any", CODE)]),
]
#: Rules in order of precedence, with the words and numbers inside them.
RETRIEVAL = [
    ("false", [("words_at_most", 2), ("equals", NO_RETRIEVE)]),
    ("false", [("words_at_most", 2), ("starts", [f"{w} " for w in NO_RETRIEVE])]),
    ("false", [("words_at_most", 6), ("starts", NO_RETRIEVE_META)]),
    ("true", [("any", RETRIEVE)]),
    ("true", [("words_over", 3)]),
]
#: Rules in order of precedence, with the words and numbers inside them.
ROUTES = [
    ("agent", [("none", AGENT_RUN), ("any", AGENT_CREATE)]),
    ("code", [("any", CODE_VERBS), ("any", CODE_NOUNS)]),
]


def words(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def _either(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, parts)


def _condition(q: Column, kind: str, value) -> Column:
    n = F.size(words(q))
    if kind == "any":
        return _either([q.contains(v) for v in value])
    if kind == "none":
        return ~_either([q.contains(v) for v in value])
    if kind == "all":
        return reduce(lambda a, b: a & b, [q.contains(v) for v in value])
    if kind == "starts":
        return _either([q.startswith(v) for v in value])
    if kind == "equals":
        return q.isin(*value)
    if kind == "regex":
        return q.rlike(value)
    if kind == "words_at_most":
        return n <= value
    if kind == "words_over":
        return n > value
    return F.length(q) - F.length(F.replace(q, F.lit("?"), F.lit(""))) > value


def decide(text: Column, rules: list, default: str) -> Column:
    """The first rule whose conditions all hold."""
    q = F.lower(text)
    out = None
    for name, conditions in rules:
        all_ = reduce(lambda a, b: a & b, [_condition(q, k, v) for k, v in conditions])
        out = F.when(all_, name) if out is None else out.when(all_, name)
    return out.otherwise(default)


def intent(text: Column) -> Column:
    return decide(text, INTENTS, "GeneralKnowledge")


def context_intent(text: Column) -> Column:
    return decide(text, CONTEXTS, "DocumentQuery")


def should_retrieve(text: Column) -> Column:
    return decide(text, RETRIEVAL, "false") == "true"


def route(text: Column) -> Column:
    return decide(text, ROUTES, "search")


#: What a query of each intent asks of the store (strategy, results, confidence).
STRATEGIES = {
    "Greeting": ("None", 0, 0.95), "SimpleAcknowledgment": ("None", 0, 0.95), "MetaQuestion": ("None", 0, 0.9), "Clarification": ("None", 0, 0.8), "FollowUpRequest": ("None", 0, 0.85), "CreativeGeneration": ("None", 0, 0.9),
    "ExampleCreation": ("None", 0, 0.9), "Calculation": ("None", 0, 0.85), "CurrentEvents": ("Web", 5, 0.85), "RealTimeInfo": ("Web", 5, 0.9), "FilteredSearch": ("Filtered", 20, 0.85), "ComparativeAnalysis": ("MultiStage", 15, 0.8),
    "AggregationQuery": ("Filtered", 50, 0.8), "TemporalQuery": ("Filtered", 15, 0.8), "MultiHopReasoning": ("MultiStage", 20, 0.75), "DocumentSearch": ("TopK", 10, 0.9), "DefinitionQuery": ("TopK", 5, 0.8), "GeneralKnowledge": ("Hybrid", 5, 0.5), "FactualLookup": ("TopK", 5, 0.75),
}


def strategy(intent_: Column) -> Column:
    """struct(strategy, k, confidence) of an intent."""
    table = F.create_map(*(x for name, (s, k, c) in STRATEGIES.items() for x in (F.lit(name), F.struct(F.lit(s).alias("strategy"), F.lit(k).alias("k"), F.lit(c).alias("confidence")))))
    return table[intent_]


#: What asks for a filter.
FILTERING = [">", "<", "where", "greater than", "less than"]


def requirements(text: Column) -> Column:
    """struct(filtering, year, first_day, last_day, above, below, names): whether a filter is asked for, the first year and its days, the number after the first > and after the first <, capitalised names."""
    year = F.regexp_extract(text, r"\b((?:19|20)\d{2})\b", 1).try_cast("int")
    number = lambda sign: F.regexp_extract(text, rf"^[^{sign}]*{sign}\s*([0-9.]+)", 1).try_cast("double")
    asked = F.lit(False)
    for word in FILTERING:
        asked = asked | text.contains(word)
    return F.struct(
        asked.alias("filtering"), year.alias("year"), F.make_date(year, F.lit(1), F.lit(1)).alias("first_day"), F.make_date(year, F.lit(12), F.lit(31)).alias("last_day"), number(">").alias("above"), number("<").alias("below"),
        F.array_distinct(F.regexp_extract_all(text, F.lit(r"[A-Z][a-z]+(?: [A-Z][a-z]+)*"), F.lit(0))).alias("names"),
    )


def keywords(text: Column) -> Column:
    """Words of the query without punctuation at their ends and without stop words."""
    bare = F.transform(words(F.lower(text)), lambda w: F.regexp_replace(w, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", ""))
    return F.filter(bare, lambda w: (F.octet_length(w) > 1) & ~w.isin(*STOP_WORDS))


def synonym_variant(text: Column) -> Column:
    """The query with its first known term replaced by a stand-in that it lacks; null without one."""
    out = None
    for term, stand_ins in SYNONYMS:
        for word in stand_ins.split():
            fits = text.contains(term) & ~text.contains(word)
            new = F.regexp_replace(text, f"^(.*?){term}", f"$1{word}")
            out = F.when(fits, new) if out is None else out.when(fits, new)
    return out.otherwise(F.lit(None))


def expand(text: Column) -> Column:
    """Up to three variants of a query of 2 to 20 words: itself, its keywords, a synonym variant."""
    q = F.lower(text)
    n = F.size(words(q))
    variants = F.array_distinct(F.filter(F.array(q, F.array_join(keywords(text), " "), synonym_variant(q)), lambda v: v.isNotNull() & (v != "")))
    return F.when(n.between(2, 20), F.slice(variants, 1, 3)).otherwise(F.array(q))


#: Pairs of words joined by "and" that are one thing.
ONE_THING = ["pros and cons", "terms and conditions", "research and development", "profit and loss", "supply and demand", "trial and error", "black and white", "back and forth"]


def decompose(text: Column) -> Column:
    """struct(strategy, parts): enumerated lines, several questions, a comparison, a conjunction, or the query itself."""
    trimmed = F.trim(text)
    lines = F.regexp_extract_all(trimmed, F.lit(r"(?m)^\s*(?:\d+[.)]\s*|[-•]\s+)(.+)$"), F.lit(1))
    questions = F.filter(F.transform(F.split(trimmed, r"\?\s+"), lambda x: F.trim(F.rtrim(x))), lambda x: x != "")
    pair = r"(?i)between\s+(.+?)\s+and\s+(.+?)(?:\s|$|\?)"
    a, b = F.trim(F.regexp_extract(trimmed, pair, 1)), F.trim(F.regexp_extract(trimmed, pair, 2))
    compares = trimmed.rlike(r"(?i)\b(?:compare|difference between|versus|vs\.?|differ from)\b") & (a != "") & (F.size(words(a)) <= 5) & (F.size(words(b)) <= 5)
    parts = F.transform(F.split(trimmed, r"(?i)\s+and\s+"), lambda x: F.trim(x))
    joined = (F.size(parts) > 1) & F.forall(parts, lambda x: F.size(words(x)) >= 3) & ~_either([F.lower(trimmed).contains(w) for w in ONE_THING])
    make = lambda s, p: F.struct(F.lit(s).alias("strategy"), p.alias("parts"))
    return (
        F.when(F.size(words(trimmed)) < 5, make("Single", F.array(trimmed)))
        .when(F.size(lines) > 1, make("Enumerated", F.transform(lines, lambda x: F.trim(x))))
        .when(F.size(questions) > 1, make("MultiQuestion", questions))
        .when(compares, make("Comparative", F.array(trimmed, a, b)))
        .when(joined, make("Conjunction", parts))
        .otherwise(make("Single", F.array(trimmed)))
    )


#: Words that ask for everything; a place together with a plural that ask for all of a kind.
BROAD = ["all ", "every ", "list ", "each ", "everyone", "everything"]
BROAD_PLACES = ["from ", "in the ", "across "]
BROAD_PLURALS = ["emails", "names", "phones", "numbers", "addresses", "ids", "details", "records"]
#: Words without meaning for relevance; terms of two domains; what document types of these domains contain.
RELEVANCE_STOP_WORDS = "the a an is are was were in on at to for of and or but with from by as how what where when why which who i you me my your".split()
LEGAL_TERMS = ["contract", "agreement", "clause", "liability", "indemnity", "breach", "party", "provision", "termination"]
TAX_TERMS = ["gst", "tax", "return", "invoice", "itr", "section", "assessment", "audit", "compliance"]
LEGAL_TYPES = ["contract", "agreement", "legal"]
TAX_TYPES = ["gst", "tax", "itr"]


def _holds_any(text: Column, parts: list[str]) -> Column:
    return _either([text.contains(x) for x in parts])


def is_broad(text: Column) -> Column:
    """The query asks for everything of a kind, so more results are wanted."""
    low = F.lower(text)
    return _holds_any(low, BROAD) | (_holds_any(low, BROAD_PLACES) & _holds_any(low, BROAD_PLURALS))


def relevance_keywords(text: Column) -> Column:
    """Lower-cased words of more than two bytes that are no stop words, with repeats."""
    return F.filter(F.split(F.lower(text), r"\s+"), lambda w: (F.octet_length(w) > 2) & ~w.isin(RELEVANCE_STOP_WORDS))


def domain_match(text: Column, has_legal: Column, has_tax: Column) -> Column:
    """0.9 when the query's domain is among the documents, 0.1 when it is not, 0.5 when it has none."""
    low = F.lower(text)
    legal, tax = _holds_any(low, LEGAL_TERMS), _holds_any(low, TAX_TERMS)
    return F.when((legal & has_legal) | (tax & has_tax), 0.9).when((legal & ~has_legal) | (tax & ~has_tax), 0.1).otherwise(0.5)
