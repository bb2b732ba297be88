"""Tagging a table of questions and answering the statistical ones by join."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulary.functions.columns import as_double, numeric_columns, quoted, small_side
from tabulary.functions.text import strip, tokens
from tabulary.operators.stats import STAT_ALIASES, stats_table
from tabulary.operators.thresholds import counts_at_thresholds
from tabulary.session import written

# Question patterns in the order in which they are tried.
STATISTICAL_PATTERNS = (
    (r"^(average|avg|mean|median|sum|total|min|minimum|max|maximum|count|std|variance)\s+(\w+)$", "direct_stat"),
    (r"^(mean|average|sum|total|median)\s+(of\s+)?(all\s+)?(\w+)$", "direct_stat_verbose"),
    (r"^(mean|average|sum|total|median)\s+(\w+\s+\w+)$", "direct_stat_compound"),
    (r"^what is the\s+(\w+)\s+range$", "range"),
    (r"^(\w+)\s+range$", "range"),
    (r"^range of\s+(\w+\s*\w*)$", "range"),
    (r"^what is the range of\s+(\w+)$", "range"),
    (r"^what is range of\s+(\w+)$", "range"),
    (r"^(\w+)\s+range of\s+(\w+)$", "range"),
    (r"^(minimum and maximum|min and max)\s+(\w+)$", "range_pair"),
    (r"^(oldest and youngest|youngest and oldest)\s+(\w+)$", "range_pair"),
    (r"^(highest and lowest|lowest and highest)\s+(\w+)$", "range_pair"),
    (r"^(total number of|number of|total)\s+(\w+)$", "count"),
    (r"how many\s+(\w+)\s+(are|is)\s+(older than|greater than|above|over)\s+(\d+)", "conditional_count_greater"),
    (r"how many\s+(\w+)\s+(are|is)\s+(younger than|less than|below|under)\s+(\d+)", "conditional_count_less"),
    (r"how many\s+(\w+)\s+(are|is)\s+(exactly|equal to)\s+(\d+)", "conditional_count_equal"),
    (r"^(how many|count of|number of)\s+", "count"),
    (r"^count\s+", "count"),
    (r"who\s+is\s+(the\s+)?(highest|lowest|best|worst|top|bottom)\s+paid", "superlative_salary"),
    (r"who\s+(has|have|earns|makes)\s+(the\s+)?(highest|lowest|most|least|maximum|minimum)\s+(salary|income|pay)", "superlative_salary"),
    (r"(highest|lowest|maximum|minimum|best|worst|top|bottom)\s+paid\s+(\w+)", "superlative_salary"),
    (r"^(highest|lowest|maximum|minimum)\s+paid(\s+\w+)?$", "superlative_salary"),
    (r"^(minimum|maximum|lowest|highest)\s+(salary|income|pay)(\s+\w+)?$", "superlative_salary"),
    (r"who\s+is\s+(the\s+)?(oldest|youngest)", "superlative_age"),
    (r"^(youngest|oldest)\s+(employee|person|worker)(\s+in\s+the\s+company)?", "superlative_age"),
    (r"(oldest|youngest|tallest|shortest)\s+(\w+)", "superlative_general"),
    (r"who\s+(has|have)\s+(the\s+)?(best|highest|worst|lowest)\s+(performance|rating)", "superlative_performance"),
    (r"^(best|worst|highest|lowest)\s+(performer|performance|rating)", "superlative_performance"),
    (r"what\s+is\s+the\s+(average|mean|sum|total|min|minimum|max|maximum|count)\s+(\w+)", "what_is_stat"),
    (r"(\w+)\s+(greater than|less than|above|below|over|under)\s+(\d+)", "comparison"),
)
VISUALIZATION_PATTERNS = (
    r"(plot|chart|graph|visualize|show)\s+",
    r"create\s+(a\s+)?(plot|chart|graph|histogram|scatter)",
    r"(bar chart|line chart|pie chart|scatter plot|histogram)",
)
ROW_SEARCH_PATTERNS = (
    r"show\s+me\s+(all\s+)?(\w+)\s+(where|with|that)",
    r"find\s+(all\s+)?(\w+)\s+(where|with|that)",
    r"list\s+(all\s+)?(\w+)\s+(where|with|that)",
)

# How sure each kind of question is.
CONFIDENCE = {"count": 0.9, "superlative_general": 0.7, "comparison": 0.7}
STATISTICAL_CONFIDENCE = 0.95
VISUALIZATION_CONFIDENCE = 0.9
ROW_SEARCH_CONFIDENCE = 0.8
SEMANTIC_CONFIDENCE = 0.3

# Other names of well-known columns, in the order in which they are tried.
COLUMN_ALIASES = {
    "salary": ("salary", "salaries", "pay", "income", "compensation", "wage", "earnings"),
    "age": ("age", "ages", "years", "age_years"),
    "name": ("name", "names", "employee_name", "full_name", "first_name", "employee"),
    "department": ("department", "departments", "dept", "division", "team"),
    "performance": ("performance", "performance_rating", "rating", "ratings", "score", "evaluation"),
    "performance_rating": ("performance_rating", "performance", "rating", "ratings", "score", "evaluation"),
}

# Words that ask for a chart, and chart names in the order of preference.
CHART_WORDS = (
    "show", "plot", "chart", "graph", "visualize", "display",
    "histogram", "bar", "scatter", "line", "pie", "distribution",
)
CHART_TYPES = ("histogram", "bar", "scatter", "line", "pie", "box")

# What hints at a search for rows, and what rules it out.
ROW_WORDS = (
    "customers", "people", "employees", "records", "individuals", "persons", "staff", "workers",
    "find", "show", "list", "get", "who", "which", "search", "locate", "identify",
    "engineers", "sales", "marketing", "finance", "hr", "managers", "developers",
    "wealthy", "high", "top", "best", "experienced", "senior", "junior", "new",
    "in", "from", "at", "living", "located", "based", "working",
)
ROW_PLACES = (
    "san francisco", "new york", "california", "texas", "chicago", "boston",
    "seattle", "austin", "denver", "miami", "portland", "los angeles",
)
ROW_PHRASES = (
    "in ", "from ", "at ", "with ", "who ", "which ", "that ",
    "engineers in", "people in", "employees in", "customers in",
    "staff in", "workers in", "sales in", "marketing in",
)
NOT_ROW_STATS = ("average", "mean", "sum", "count", "total", "max", "min", "median", "std")
NOT_ROW_CHARTS = (
    "show histogram", "plot", "chart", "graph", "visualize", "bar chart", "scatter",
)
SHOWN_PEOPLE = ("employees", "people", "customers", "staff", "records")

# Patterns of the kinds of search; each pattern that occurs counts one.
SEARCH_PATTERNS = {
    "data_analysis": (
        r"analyze|analysis|examine|study",
        r"statistics|statistical|stats|distribution",
        r"correlation|relationship|trend|pattern",
    ),
    "column_search": (
        r"column|field|attribute|variable",
        r"what.*columns?|list.*columns?|show.*columns?",
        r"data types?|dtype|schema",
    ),
    "statistical": (
        r"mean|average|median|mode|std|variance",
        r"min|max|count|sum|total",
        r"quartile|percentile|outlier",
    ),
    "filter_search": (
        r"where|filter|select|find.*with",
        r"greater than|less than|equal|contains",
        r"between|range|above|below",
    ),
}

# Synonyms; a search adds the first two of each word.
SYNONYMS = {
    "analyze": ("examine", "study", "investigate", "review"),
    "statistics": ("stats", "statistical", "metrics", "measures"),
    "data": ("dataset", "information", "records", "table"),
    "column": ("field", "attribute", "variable", "feature"),
    "row": ("record", "entry", "observation", "instance"),
    "correlation": ("relationship", "association", "connection"),
    "distribution": ("spread", "pattern", "frequency"),
    "average": ("mean", "typical", "standard"),
    "total": ("sum", "aggregate", "combined"),
    "trend": ("pattern", "direction", "movement"),
    "outlier": ("anomaly", "exception", "unusual"),
    "missing": ("null", "empty", "blank"),
    "unique": ("distinct", "different", "separate"),
}
SYNONYMS_USED = 2


def java(pattern: str) -> str:
    """Unicode word classes, and ``.`` stopping at newlines only."""
    return "(?Ud)" + pattern


def any_of(parts: Sequence[str]) -> str:
    return "|".join(re.escape(part) for part in parts)


def normal_question(text: Column) -> Column:
    return strip(F.lower(text))


def _first(candidates: Sequence[tuple[Column, Column]], default: Column) -> Column:
    chain = None
    for condition, value in candidates:
        chain = F.when(condition, value) if chain is None else chain.when(condition, value)
    return chain.otherwise(default) if chain is not None else default


def tag_questions(questions: DataFrame, text: str = "question") -> DataFrame:
    """Adds what a question asks for: type, confidence, operation, target and condition.

    The first matching pattern decides; statistics come before charts, charts before row
    searches. ``entity`` is what a conditional count names; ``target`` the column meant.
    """
    asked = questions.withColumn("_q", normal_question(F.col(text)))
    first_match = _first(
        [
            (F.col("_q").rlike(java(pattern)), F.lit(i))
            for i, (pattern, _) in enumerate(STATISTICAL_PATTERNS)
        ],
        F.lit(-1),
    )
    # exploding one number keeps later filters from repeating the whole pattern chain
    asked = asked.select("*", F.explode(F.array(first_match)).alias("_p"))
    words, pattern_no = F.col("_q"), F.col("_p")

    def part(groups: dict[str, int], default: str | None = None) -> Column:
        """The regex group each kind of pattern keeps its answer in."""
        found = [
            (pattern_no == i, F.regexp_extract(words, java(pattern), groups[kind]))
            for i, (pattern, kind) in enumerate(STATISTICAL_PATTERNS)
            if kind in groups
        ]
        return _first(found, F.lit(default).cast("string"))

    kind = F.get(F.array(*[F.lit(k) for _, k in STATISTICAL_PATTERNS]), pattern_no)
    asked = asked.withColumns(
        {
            "pattern_type": kind,
            "_op": part(
                {
                    "direct_stat": 1,
                    "direct_stat_verbose": 1,
                    "direct_stat_compound": 1,
                    "what_is_stat": 1,
                }
            ),
            "_target": part(
                {
                    "direct_stat": 2,
                    "direct_stat_verbose": 4,
                    "direct_stat_compound": 2,
                    "what_is_stat": 2,
                    "range": 1,
                    "range_pair": 2,
                }
            ),
            "entity": part({f"conditional_count_{sign}": 1 for sign in ("greater", "less", "equal")}),
            "_value": part({f"conditional_count_{sign}": 4 for sign in ("greater", "less", "equal")}),
        }
    )
    pattern_type, target = F.col("pattern_type"), F.col("_target")
    aliases = F.create_map(*[F.lit(x) for pair in STAT_ALIASES.items() for x in pair])
    largest = F.lit("max")
    smallest = F.lit("min")
    operation = (
        F.when(F.col("_op").isNotNull(), aliases[F.col("_op")])
        .when(pattern_type.isin("range", "range_pair"), "range")
        .when(pattern_type == "count", "count")
        .when(pattern_type.startswith("conditional_count_"), "conditional_count")
        .when(
            pattern_type == "superlative_salary",
            F.when(words.rlike("highest|most|maximum|top|best"), largest).otherwise(smallest),
        )
        .when(
            pattern_type == "superlative_age",
            F.when(words.contains("oldest"), largest).otherwise(smallest),
        )
        .when(
            pattern_type == "superlative_performance",
            F.when(words.rlike("best|highest"), largest).otherwise(smallest),
        )
    )
    ranged = (
        F.when(target.contains("age"), "age")
        .when(target.rlike("salary|salaries"), "salary")
        .when(target.contains("performance"), "performance_rating")
        .otherwise(strip(target))
    )
    compound = (
        F.when(target.contains("performance") & target.contains("rating"), "performance_rating")
        .when(target.rlike("salary|salaries"), "salary")
        .otherwise(F.replace(target, F.lit(" "), F.lit("_")))
    )
    meant = (
        F.when(pattern_type.isin("range", "range_pair"), ranged)
        .when(pattern_type == "direct_stat_compound", compound)
        .when(pattern_type.startswith("conditional_count_") | (pattern_type == "superlative_age"), "age")
        .when(pattern_type == "superlative_salary", "salary")
        .when(pattern_type == "superlative_performance", "performance_rating")
        .otherwise(target)
    )
    visual = reduce(lambda a, b: a | b, [words.rlike(java(p)) for p in VISUALIZATION_PATTERNS])
    rows = reduce(lambda a, b: a | b, [words.rlike(java(p)) for p in ROW_SEARCH_PATTERNS])
    statistical = pattern_type.isNotNull()
    query_type = (
        F.when(statistical, "statistical")
        .when(visual, "visualization")
        .when(rows, "row_search")
        .otherwise("semantic")
    )
    special = [(pattern_type == k, F.lit(v)) for k, v in CONFIDENCE.items()]
    confidence = (
        F.when(statistical, _first(special, F.lit(STATISTICAL_CONFIDENCE)))
        .when(F.col("query_type") == "visualization", F.lit(VISUALIZATION_CONFIDENCE))
        .when(F.col("query_type") == "row_search", F.lit(ROW_SEARCH_CONFIDENCE))
        .otherwise(F.lit(SEMANTIC_CONFIDENCE))
    )
    sign = (
        F.when(pattern_type == "conditional_count_greater", ">")
        .when(pattern_type == "conditional_count_less", "<")
        .when(pattern_type == "conditional_count_equal", "==")
    )
    return (
        asked.withColumn("query_type", query_type)
        .withColumns(
            {
                "confidence": confidence,
                "op": operation,
                "target": meant,
                "cond_op": sign,
                "cond_value": F.col("_value").try_cast("long"),
            }
        )
        .select(
            *questions.columns,
            "query_type",
            # The patterns of two words are a kind of range that takes its column elsewhere.
            F.regexp_replace("pattern_type", "^range_pair$", "range").alias("pattern_type"),
            "confidence",
            "op",
            "target",
            "entity",
            "cond_op",
            "cond_value",
        )
    )


def detect_viz_intent(questions: DataFrame, text: str = "question") -> DataFrame:
    """Whether a chart is asked for, which one, and the words that may name columns."""
    asked = F.col("_q")
    charted = asked.rlike(any_of(CHART_WORDS))
    named = [(asked.contains(chart), F.lit(chart)) for chart in CHART_TYPES]
    guessed = (
        F.when(asked.contains("vs") | asked.contains("versus"), "scatter")
        .when(asked.contains("distribution"), "histogram")
        .when(asked.contains("bar") | asked.contains("count"), "bar")
        .otherwise("histogram")
    )
    candidates = F.transform(
        F.filter(tokens(asked), lambda w: ~w.isin(*CHART_WORDS) & (F.length(w) > 2)),
        lambda w: F.regexp_replace(w, r"^[().,!?]+|[().,!?]+$", ""),
    )
    return questions.withColumn("_q", normal_question(F.col(text))).select(
        *questions.columns,
        charted.alias("is_visualization"),
        F.when(charted, _first(named, guessed)).alias("chart_type"),
        F.when(charted, F.array_join(candidates, " ")).alias("candidate_columns"),
    )


def detect_row_search(questions: DataFrame, text: str = "question") -> DataFrame:
    """Whether a question looks for data rows."""
    asked = F.col("_q")
    hinted = asked.rlike(any_of((*ROW_WORDS, *ROW_PLACES, *ROW_PHRASES)))
    charted = asked.rlike(any_of(NOT_ROW_CHARTS))
    counted = asked.rlike(any_of(NOT_ROW_STATS))
    shown = asked.startswith("show ") & ~charted & asked.rlike(any_of(SHOWN_PEOPLE))
    return questions.withColumn("_q", normal_question(F.col(text))).select(
        *questions.columns,
        ((hinted & ~counted & ~charted) | shown).alias("is_row_search"),
    )


def search_type(text: Column) -> Column:
    """The kind of search with most matching patterns; ties to the one listed first."""
    lowered = F.lower(text)
    scores = {
        name: reduce(
            lambda a, b: a + b, [lowered.rlike(java(p)).cast("int") for p in patterns]
        )
        for name, patterns in SEARCH_PATTERNS.items()
    }
    best = F.greatest(*scores.values())
    return F.when(best == 0, "general").otherwise(
        _first([(score == best, F.lit(name)) for name, score in scores.items()], F.lit("general"))
    )


def expand_query(text: Column) -> Column:
    """Each lower-cased word followed by its first synonyms."""
    known = F.create_map(
        *[
            item
            for word, others in SYNONYMS.items()
            for item in (F.lit(word), F.array(*[F.lit(o) for o in others[:SYNONYMS_USED]]))
        ]
    )
    expanded = F.transform(
        tokens(text),
        lambda w: F.concat(F.array(w), F.coalesce(known[w], F.array().cast("array<string>"))),
    )
    return F.array_join(F.flatten(expanded), " ")


def _alias_columns(columns: Sequence[str]) -> dict[str, str]:
    """The column each well-known name stands for: whole words first, parts of words last."""
    found = {}
    for key, alternatives in COLUMN_ALIASES.items():
        whole = [c for a in alternatives for c in columns if f"_{a}_" in f"_{c.lower()}_"]
        part = [c for a in alternatives for c in columns if a in c.lower()]
        if whole or part:
            found[key] = (whole or part)[0]
    return found


def map_column_name(target: Column, columns: Sequence[str]) -> Column:
    """The column a question means: by name, by a well-known name, by a part of the name."""
    names = F.array(*[F.lit(c) for c in columns])
    wanted = F.lower(target)
    singular = F.regexp_replace(wanted, "s$", "")
    exact = F.filter(names, lambda c: (F.lower(c) == wanted) | (F.lower(c) == singular))
    options = [F.get(exact, F.lit(0))]
    aliases = _alias_columns(columns)
    if aliases:
        known = F.create_map(*[F.lit(x) for pair in aliases.items() for x in pair])
        options += [known[wanted], known[singular]]
    for key in (wanted, singular):
        options.append(F.get(F.filter(names, _shares_text(key)), F.lit(0)))
    return F.coalesce(*options)


def _shares_text(key: Column) -> Callable[[Column], Column]:
    return lambda name: F.contains(F.lower(name), key) | F.contains(key, F.lower(name))


def dataset_facts(dataset: DataFrame, name_column: str, key_column: str) -> DataFrame:
    """Every answer a dataset can give: ``(column, op, value, value_high, row_name)``.

    A few rows per column; an empty column stands for the rows themselves.
    """
    numbers = numeric_columns(dataset)
    statistics = stats_table(dataset, numbers)
    key = as_double(dataset.schema[key_column])
    extremes = []
    for i, name in enumerate(numbers):
        value = as_double(dataset.schema[name])
        place = F.when(value.isNotNull(), F.struct(value, key))
        reversed_place = F.when(value.isNotNull(), F.struct(value, -key))
        extremes.append(F.max_by(quoted(name_column), reversed_place).alias(f"_hi{i}"))
        extremes.append(F.min_by(quoted(name_column), place).alias(f"_lo{i}"))
    others = [c for c in dataset.columns if c not in numbers]
    row = dataset.agg(
        F.count(F.lit(1)).cast("double").alias("_rows"),
        *[F.min(as_double(dataset.schema[n])).alias(f"_min{i}") for i, n in enumerate(numbers)],
        *[F.max(as_double(dataset.schema[n])).alias(f"_max{i}") for i, n in enumerate(numbers)],
        *[F.count(quoted(c)).cast("double").alias(f"_n{i}") for i, c in enumerate(others)],
        *extremes,
    )

    def fact(column: str, op: str, value: Column, high: Column, name: Column) -> Column:
        return F.struct(
            F.lit(column).alias("column"),
            F.lit(op).alias("op"),
            value.alias("value"),
            high.alias("value_high"),
            name.alias("row_name"),
        )

    no_value, no_name = F.lit(None).cast("double"), F.lit(None).cast("string")
    facts = [fact("", "count", F.col("_rows"), no_value, no_name)]
    for i, name in enumerate(numbers):
        low, high = F.col(f"_min{i}"), F.col(f"_max{i}")
        facts.append(fact(name, "range", low, high, no_name))
        facts.append(fact(name, "max", high, no_value, F.col(f"_hi{i}").cast("string")))
        facts.append(fact(name, "min", low, no_value, F.col(f"_lo{i}").cast("string")))
    for i, name in enumerate(others):
        facts.append(fact(name, "count", F.col(f"_n{i}"), no_value, no_name))
    special = row.select(F.explode(F.array(*facts)).alias("_f")).select("_f.*")
    plain = statistics.filter(~F.col("stat").isin("min", "max")).select(
        "column",
        F.col("stat").alias("op"),
        "value",
        no_value.alias("value_high"),
        no_name.alias("row_name"),
    )
    return special.unionByName(plain)


def answer_questions(
    tagged: DataFrame, dataset: DataFrame, name_column: str, key_column: str
) -> DataFrame:
    """Answers for tagged questions, or a message why there is none.

    Facts are a few rows per column, so they are broadcast; conditional counts join on
    their distinct conditions.
    """
    columns = dataset.columns
    entity_name = F.lower(F.col("entity"))
    by_entity = [
        (entity_name.isin(c.lower(), c.lower() + "s"), F.lit(c)) for c in numeric_columns(dataset)
    ]
    conditional = F.col("op") == "conditional_count"
    mapped = map_column_name(F.col("target"), columns)
    meant = F.when(conditional, _first(by_entity, mapped)).otherwise(mapped)
    # written once: both the conditions and the answers start from the tagged questions
    resolved = written(tagged.withColumn("column", meant), "questions")
    conditions = resolved.filter(
        conditional & F.col("column").isin(*numeric_columns(dataset))
    ).select("column", F.col("cond_value").alias("threshold"))
    counts = small_side(counts_at_thresholds(dataset, conditions), store=True)
    counts = counts.withColumnRenamed("column", "_ccol")
    facts = F.broadcast(
        dataset_facts(dataset, name_column, key_column)
        .withColumnRenamed("column", "_fcol")
        .withColumnRenamed("op", "_fop")
    )
    looked_up = F.when(
        (F.col("op") == "count") & F.col("column").isNull(), F.lit("")
    ).otherwise(F.col("column"))
    joined = resolved.join(
        facts, (looked_up == F.col("_fcol")) & (F.col("op") == F.col("_fop")), "left"
    ).join(
        counts,
        conditional
        & (F.col("column") == F.col("_ccol"))
        & (F.col("cond_value").cast("double") == F.col("threshold")),
        "left",
    )
    counted = (
        F.when(F.col("cond_op") == ">", F.col("above"))
        .when(F.col("cond_op") == "<", F.col("below"))
        .otherwise(F.col("equal"))
    )
    answer = F.when(conditional, counted.cast("double")).otherwise(F.col("value"))
    message = (
        F.when(
            F.col("query_type") != "statistical",
            F.concat(F.lit("Routed to "), F.col("query_type")),
        )
        .when(F.col("op").isNull(), "Unsupported question")
        .when(answer.isNotNull(), F.lit(None).cast("string"))
        .when(
            F.col("column").isNull(),
            F.concat(F.lit("Column '"), F.col("target"), F.lit("' not found in dataset.")),
        )
        .when(conditional & F.col("cond_value").isNull(), "The number is out of range")
        .otherwise(
            F.concat(
                F.lit("Result is NaN - column '"),
                F.col("column"),
                F.lit("' may contain non-numeric data"),
            )
        )
    )
    return joined.select(
        *tagged.columns,
        "column",
        answer.alias("answer"),
        "value_high",
        "row_name",
        message.alias("message"),
    )
