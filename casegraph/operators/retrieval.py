"""Keyword retrieval without vectors: keywords, intents, scored excerpts, enrichment, sessions."""

from __future__ import annotations

import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# The stop words of keyword extraction, and the patterns of intents with their confidences, first match first.
STOP_WORDS = ("the", "a", "an", "in", "of", "for", "on", "to", "at", "by", "with", "from", "is", "was", "are", "were", "what", "how", "show", "tell", "describe", "give", "find", "about", "me", "and", "or", "but", "not")
INTENTS = (
    ("network", 0.95, r"\b(associates?|linked\s+to|connected|co-accused|network|relationships?)\b"),
    ("risk", 0.95, r"\b(risk\s+score|high-risk|repeat\s+offender|risk\s+level|dangerous|threat\s+level)\b"),
    ("narrative", 0.85, r"\b(describe|what\s+happened|tell\s+me\s+about|modus\s+operandi|summary\s+of|overview\s+of|details?\s+about\s+case|brief\s+facts|incident\s+details?|sequence\s+of\s+events)\b"),
    ("analytical", 0.95, r"\b(predict|forecast|next\s+month|hotspot|trend(?:s|ing)?|pattern(?:s)?|seasonal|analysis|analytics|statistics?|breakdown|compare|most\s+common|crime\s+(?:trends?|analysis|statistics?|pattern|data|overview))\b"),
    ("structured", 0.85, r"\b(how many|count|total|list\s+\w+|show\s+(me|all|the|FIR)|find\s+\w+|get\s+(me|all|the)|cases?\s+(in|registered|filed|reported)|FIR\s+details?|accused\s+details?|victim\s+details?|officer\s+|section\s+\w+|IPC|CrPC|charge\s+sheet)\b"),
)

# Words that are no part of a name, those of commands at the end; where names stand in a question; districts by their old and new names.
NOT_NAMES = tuple((
    "show me the find get list what how who which all any describe tell about for of with and network associates connections linked connected risk score trend pattern crime cases case in at on by to from is was are were "
    "has have been being do does did will would could should can may might shall not no nor but or if then else than that this these those his her its their your our my mine yours theirs itself himself herself myself "
    "involved crimes assess check calculate evaluate analyse analyze person"
).split())
NAME_PATTERNS = (
    r"(?:associates?|connected|linked|co-accused|network|find|search|about)\s+(?:of\s+)?(\w+(?:\s+\w+)?)",
    r"(?:risk\s+)?score\s+(?:of\s+|for\s+)?(\w+(?:\s+\w+)?)",
    r"(\w+(?:\s+\w+)?)(?:'s)?\s+(?:associates?|network|connections?|links?|relations?|risk\s+score)",
)
DISTRICTS = (
    "Bengaluru", "Bangalore", "Mysuru", "Mysore", "Hubli", "Dharwad", "Belagavi", "Belgaum", "Mangaluru", "Mangalore", "Shivamogga", "Shimoga", "Tumakuru", "Tumkur", "Kalaburagi", "Gulbarga", "Ballari", "Bellary", "Vijayapura",
    "Bijapur", "Davanagere", "Udupi", "Hassan", "Chitradurga", "Raichur", "Kolar", "Bidar", "Haveri", "Mandya", "Kodagu", "Chikkamagaluru", "Chikmagalur", "Ramanagara", "Chikkaballapur", "Yadgir", "Gadag",
)


def person_name(query: Column) -> Column:
    """The person that a question is about: an id, else what follows or precedes the words that ask for a person, else the first word that may be a name; null for none."""
    plain = lambda w: ~F.lower(w).isin(*NOT_NAMES)
    of = lambda p: F.regexp_extract(query, "(?i)" + p, 1)
    told = [F.when((F.length(of(p)) > 1) & F.forall(F.split(of(p), r"\s+"), plain), F.trim(of(p))) for p in NAME_PATTERNS]
    words = F.transform(F.split(query, r"\s+"), lambda w: F.regexp_replace(w, "[^a-zA-Z]", ""))
    own = F.get(F.filter(words, lambda w: (F.length(w) > 2) & plain(w)), F.lit(0))
    marked = F.regexp_extract(query, r"(?i)\bPM_([0-9a-f]{8})\b", 1)
    return F.coalesce(F.when(F.length(marked) > 0, F.concat(F.lit("PM_"), F.lower(marked))), *told, own)


def location(query: Column) -> Column:
    """The place that a question names: capitalised words after in, of, at or for, else a known district; null for none."""
    said = F.regexp_extract(query, r"\b(?:in|of|at|for)\s+([A-Z][a-z]+(?:\s+[A-Z][a-z]+)?)\b", 1)
    known = F.get(F.filter(F.array(*(F.lit(x) for x in DISTRICTS)), lambda x: F.contains(F.lower(query), F.lower(x))), F.lit(0))
    return F.coalesce(F.when(F.length(said) > 0, said), known)


def keywords(query: Column, most: int = 5) -> Column:
    """Up to ``most`` words of three letters or more that aren't stop words."""
    plain = F.regexp_replace(F.lower(query), r"[^a-z0-9\s]", "")
    return F.slice(F.filter(F.split(plain, r"\s+"), lambda w: (F.length(w) > 2) & ~w.isin(*STOP_WORDS)), 1, most)


def keyword_union(*lists: Column, most: int = 8) -> Column:
    """The different words of several lists, in order, ``most`` of them at most."""
    return F.slice(F.array_distinct(F.concat(*lists)), 1, most)


def intent(query: Column) -> Column:
    """STRUCT<intent, confidence> of the first pattern that matches, or null."""
    out = None
    for name, confidence, pattern in INTENTS:
        value = F.struct(F.lit(name).alias("intent"), F.lit(confidence).alias("confidence"))
        hit = query.rlike("(?i)" + pattern)
        out = F.when(hit, value) if out is None else out.when(hit, value)
    return out


def excerpts(cases: DataFrame, words: list[str], newest: int = 15, top: int = 3) -> DataFrame:
    """Cases whose facts contain a keyword: of the newest ones, those with most keywords first, then the later."""
    has = [F.contains(F.lower("facts"), F.lit(w.lower())) for w in words[:5]]
    hits = cases.where(reduce(lambda a, b: a | b, has)).withColumn("score", reduce(lambda a, b: a + b, (h.cast("int") for h in has)))
    date = F.coalesce("incident", F.lit("1970-01-01").cast("timestamp"))
    return hits.orderBy(date.desc(), "case_id").limit(newest).orderBy(F.desc("score"), date.desc(), "case_id").limit(top).select("case_id", "score")


def enrich(cases: DataFrame, sections: DataFrame) -> DataFrame:
    """Cases with the list of their sections, in order; empty without any."""
    lists = sections.groupBy("case_id").agg(F.sort_array(F.collect_set("section")).alias("sections"))
    return cases.join(lists, "case_id", "left").withColumn("sections", F.coalesce("sections", F.array().cast("array<string>")))


def merge_hits(*hits: DataFrame) -> DataFrame:
    """Hits (case_id, score) of several searches: each case once, from the first search that has it, with ``retry``: no score is above 1."""
    rows = reduce(lambda a, b: a.unionByName(b), (h.select("case_id", "score", F.lit(i).alias("search")) for i, h in enumerate(hits)))
    first = rows.groupBy("case_id").agg(F.min(F.struct("search", -F.col("score"))).alias("f")).select("case_id", (-F.col("f")["col2"]).alias("score"), F.col("f.search").alias("search"))
    weak = first.agg((F.coalesce(F.max("score"), F.lit(0)) <= 1).alias("retry"))  # one row
    return first.withColumn("one", F.lit(1)).join(F.broadcast(weak.withColumn("one", F.lit(1))), "one").drop("one")


def name_hits(roles: DataFrame, words: list[str], newest: int = 15) -> DataFrame:
    """(case_id, score): of the role rows (case_id, role, name, incident) whose name contains a word, the newest ones of each
    role and word; a case scores two for each different role and name."""
    spelt = F.lower("name")
    tried = roles.where(F.length(F.trim("name")) > 0).withColumn("word", F.explode(F.array(*(F.lit(w.lower()) for w in words)))).where(F.contains(spelt, F.col("word")))
    place = F.row_number().over(Window.partitionBy("role", "word").orderBy(F.col("incident").desc_nulls_last(), "case_id", "name"))
    return tried.withColumn("place", place).where(F.col("place") <= newest).groupBy("case_id").agg((2 * F.countDistinct("role", "name")).alias("score"))


def case_by_id(cases: DataFrame, roles: DataFrame, case_id: str) -> DataFrame:
    """The case with that id, with its people by role as sorted lists, and a score of 10; empty where there is none."""
    one = cases.where(F.col("case_id").cast("string") == case_id)
    people = roles.where(F.col("case_id").cast("string") == case_id).groupBy("case_id").agg(*(F.sort_array(F.collect_set(F.when(F.col("role") == r, F.col("name")))).alias(r) for r in ("accused", "victim", "complainant")))
    return one.join(people, "case_id", "left").withColumn("score", F.lit(10))


def with_status(hits: DataFrame, cases: DataFrame, statuses: DataFrame, courts: DataFrame, sections: DataFrame) -> DataFrame:
    """Hits with their case's status, court and sections; what a case lacks is null, its list of sections empty."""
    full = hits.join(cases.select("case_id", "status_id", "court_id"), "case_id", "left").join(statuses, "status_id", "left").join(courts, "court_id", "left")
    return enrich(full.drop("status_id", "court_id"), sections)


def citations(hits: DataFrame) -> Column:
    """An aggregate: the cases that an answer rests on, in order."""
    return F.array_join(F.array_sort(F.collect_set(F.concat(F.lit("CaseMasterID:"), F.col("case_id").cast("string")))), ", ")


def slots(query: Column, districts: list[str], kinds: list[str]) -> Column:
    """STRUCT<district, kind, case_id, person_id, year>: what a question names, each the first of the known values that it contains."""
    low = F.lower(query)
    first = lambda values: F.get(F.filter(F.array(*(F.lit(v) for v in values)), lambda v: F.contains(low, F.lower(v))), F.lit(0)) if values else F.lit(None).cast("string")
    found = lambda pattern: F.nullif(F.regexp_extract(query, pattern, 1), F.lit(""))
    return F.struct(first(districts).alias("district"), first(kinds).alias("kind"), found(r"\b(\d{14,17})\b").alias("case_id"), found(r"\b(PM_[0-9a-f]{8})\b").alias("person_id"), found(r"\b(20\d{2})\b").alias("year"))


def chat_period(query: Column, today: Column) -> Column:
    """STRUCT<label, since>: the period that a question names, this or last month or year or a year from 2000 on; null for none."""
    month, year = F.trunc(today, "month"), F.trunc(today, "year")
    ahead = lambda since: F.struct(since[0].alias("label"), since[1].cast("string").alias("since"))
    last_month, named = F.add_months(month, -1), F.regexp_extract(query, r"\b(20\d{2})\b", 1)
    says = lambda x: query.rlike(rf"(?i)\b{x}\b")
    return (
        F.when(says(r"this\s+month"), ahead((F.concat(F.lit("This month ("), F.date_format(month, "MMMM"), F.lit(")")), month)))
        .when(says(r"last\s+month"), ahead((F.concat(F.lit("Last month ("), F.date_format(last_month, "MMMM"), F.lit(")")), last_month)))
        .when(says(r"this\s+year"), ahead((F.concat(F.lit("This year ("), F.year(year).cast("string"), F.lit(")")), year)))
        .when(says(r"last\s+year"), ahead((F.concat(F.lit("Last year ("), (F.year(year) - 1).cast("string"), F.lit(")")), F.add_months(year, -12))))
        .when(F.length(named) > 0, ahead((named, F.make_date(named.try_cast("int"), F.lit(1), F.lit(1)))))
    )


def dashboard_period(period: str | None, today: str) -> dict[str, str]:
    """The start and end dates of a dashboard's period (year, 6months, 3months, month), for ``dashboard.filtered``; no limits for others."""
    months = {"year": 12, "6months": 6, "3months": 3, "month": 1}.get(period or "")
    if not months:
        return {}
    end = datetime.date.fromisoformat(today)
    back = end.year * 12 + end.month - 1 - months
    # a day that the month lacks runs on into the next one
    start = datetime.date(back // 12, back % 12 + 1, 1) + datetime.timedelta(days=end.day - 1)
    return {"start": start.isoformat(), "end": end.isoformat()}


def short_label(text: Column, most: int = 20) -> Column:
    """A label of up to ``most`` characters, the last an ellipsis where it is cut."""
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most - 1), F.lit("…"))).otherwise(text)


def case_text(rows: DataFrame, fields: dict[str, str]) -> Column:
    """One text a case: a line ``title: value`` for each field, N/A for null."""
    return F.concat_ws("\n", *(F.concat(F.lit(f"{title}: "), F.coalesce(F.col(c).cast("string"), F.lit("N/A"))) for title, c in fields.items()))


def recent_sessions(turns: DataFrame, user: str, n: int = 5) -> DataFrame:
    """The ``n`` latest sessions of a user: (user, session, last, rank)."""
    last = turns.groupBy(user, "session").agg(F.max("at").alias("last"))
    return last.withColumn("rank", F.row_number().over(Window.partitionBy(user).orderBy(F.desc("last"), "session"))).where(F.col("rank") <= n)


def last_context(turns: DataFrame) -> DataFrame:
    """The last user turn of each session."""
    return turns.where(F.col("role") == "user").groupBy("session").agg(F.max("at").alias("at"), F.max_by("text", "at").alias("text"))


def follow_up(turns: DataFrame) -> DataFrame:
    """(session, question, sql, hint): the last question that a user asked, the last SQL that answered one, and what a new question is told of them; null where a session lacks one.

    ``turns``: session, at, role, text, query_context; empty texts count as none, of equal times the greater text is the last."""
    last = lambda role, c: F.max(F.when((F.col("role") == role) & (F.length(c) > 0), F.struct("at", c)))[c]
    both = turns.groupBy("session").agg(last("user", "text").alias("question"), last("assistant", "query_context").alias("sql"))
    hint = F.concat(F.lit("Follows "), F.substring("question", 1, 80), F.lit(" with "), F.substring("sql", 1, 120))
    return both.withColumn("hint", hint)
