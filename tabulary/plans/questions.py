"""Question tagging and answering over a question log made from events and conversations.

Every event asks one question: its number picks the wording, its value the threshold.
Every user turn of a conversation is a question as well. The answers come from a staff
table made of the customers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulary.operators import questions
from tabulary.plans.catalogue import q, query, rounded, table

WORDINGS = (
    "average salary",
    "Avg age",
    "median performance_rating",
    "total salary",
    "sum age",
    "minimum salary",
    "MAXIMUM age",
    "count salary",
    "count employees",
    "std salary",
    "variance age",
    "mean department",
    "mean of all salary",
    "total of age",
    "mean of all salaries",
    "mean performance rating",
    "sum salary data",
    "median head count",
    "What is the salary range",
    "age range",
    "range of employee ages",
    "what is the range of salary",
    "what is range of bonus",
    "salary range of employees",
    "min and max age",
    "oldest and youngest age",
    "highest and lowest salary",
    "number of employees",
    "total number of people",
    "how many people are older than {n}",
    "How many employees are below {n}",
    "how many staff are exactly {n}",
    "how many salary are above {n}",
    "how many employees work here",
    "count of people in sales",
    "who is the highest paid",
    "who is best paid",
    "who earns the least income",
    "lowest paid employee",
    "maximum pay",
    "who is the oldest",
    "youngest employee in the company",
    "tallest person",
    "who has the best performance",
    "worst performer",
    "what is the average salary",
    "what is the maximum age of all",
    "what is the minimum city",
    "salary greater than {n}",
    "plot salary by department",
    "create a histogram of age",
    "line chart of salary over time",
    "salary vs age scatter plot",
    "show me all employees where salary is high",
    "find all people that live in boston",
    "list customers with salary over {n}",
    "find staff with ratings",
    "show the distribution of age, salary (all)!",
    "display counts per department",
    "  analyze the correlation trend in data  ",
    "list columns and data types",
    "which column has missing or unique values",
    "filter rows where value is between {n} and 90",
    "summary statistics of the outlier distribution",
    "explain the quarterly results",
)


def event_question() -> Column:
    """The question an event asks: one of the wordings with the event's number."""
    wordings = F.array(*[F.lit(w) for w in WORDINGS])
    wording = F.element_at(wordings, (F.col("event_id") % len(WORDINGS) + 1).cast("int"))
    return F.replace(wording, F.lit("{n}"), F.floor("value").cast("string"))


def question_log(spark: SparkSession, folder: str) -> DataFrame:
    asked = table(spark, folder, "events").select(
        F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("qid"),
        event_question().alias("question"),
    )
    talked = (
        table(spark, folder, "conversations")
        .filter(F.col("role") == "user")
        .select(
            F.concat(
                F.lit("c"), F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string")
            ).alias("qid"),
            F.col("text").alias("question"),
        )
    )
    return asked.unionByName(talked)


QUESTIONS_SQL = (
    "(SELECT 'e' || event_id AS qid, replace(list_extract(["
    + ", ".join(q(w) for w in WORDINGS)
    + f"], event_id % {len(WORDINGS)} + 1), '{{n}}', CAST(CAST(floor(value) AS BIGINT) AS VARCHAR)) "
    "AS question FROM events UNION ALL "
    "SELECT 'c' || conv_id || '-' || turn, text FROM conversations WHERE role = 'user')"
)


def staff(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "customer").select(
        F.col("c_custkey").alias("employee_id"),
        F.col("c_name").alias("name"),
        (18 + (F.col("c_custkey") * 7) % 50).alias("age"),
        F.col("c_acctbal").alias("salary"),
        F.col("c_mktsegment").alias("department"),
        (1.0 + F.col("c_nationkey") % 5).alias("performance_rating"),
    )


STAFF_SQL = (
    "(SELECT c_custkey AS employee_id, c_name AS name, 18 + (c_custkey * 7) % 50 AS age, "
    "c_acctbal AS salary, c_mktsegment AS department, "
    "CAST(1.0 + c_nationkey % 5 AS DOUBLE) AS performance_rating FROM customer)"
)


def re2(pattern: str) -> str:
    """The same pattern for an engine whose word class knows ASCII only."""
    return q(pattern.replace("\\w", "[\\p{L}\\p{N}_]"))


def _case(pairs: list[tuple[str, str]], default: str = "NULL") -> str:
    return "CASE " + " ".join(f"WHEN {c} THEN {v}" for c, v in pairs) + f" ELSE {default} END"


_KINDS = [kind for _, kind in questions.STATISTICAL_PATTERNS]


def _group(groups: dict[str, int]) -> str:
    return _case(
        [
            (f"p = {i}", f"regexp_extract(w, {re2(pattern)}, {groups[kind]})")
            for i, (pattern, kind) in enumerate(questions.STATISTICAL_PATTERNS)
            if kind in groups
        ]
    )


def _tagged_sql() -> str:
    number = _case(
        [
            (f"regexp_matches(w, {re2(pattern)})", str(i))
            for i, (pattern, _) in enumerate(questions.STATISTICAL_PATTERNS)
        ],
        "-1",
    )
    ops = {
        "average": "mean",
        "avg": "mean",
        "mean": "mean",
        "median": "median",
        "sum": "sum",
        "total": "sum",
        "min": "min",
        "minimum": "min",
        "max": "max",
        "maximum": "max",
        "count": "count",
        "std": "std",
        "variance": "var",
    }
    visual = " OR ".join(f"regexp_matches(w, {re2(p)})" for p in questions.VISUALIZATION_PATTERNS)
    rows = " OR ".join(f"regexp_matches(w, {re2(p)})" for p in questions.ROW_SEARCH_PATTERNS)
    kinds = _case([(f"p = {i}", f"'{k}'") for i, k in enumerate(_KINDS)])
    stat = {"direct_stat": 1, "direct_stat_verbose": 1, "direct_stat_compound": 1, "what_is_stat": 1}
    name = {
        "direct_stat": 2,
        "direct_stat_verbose": 4,
        "direct_stat_compound": 2,
        "what_is_stat": 2,
        "range": 1,
        "range_pair": 2,
    }
    condition = {f"conditional_count_{sign}": 1 for sign in ("greater", "less", "equal")}
    value = dict.fromkeys(condition, 4)
    return f"""
    WITH a AS (SELECT qid, question, regexp_replace(lower(question), '^\\s+|\\s+$', '', 'g') AS w
               FROM {QUESTIONS_SQL}),
    b AS (SELECT *, {number} AS p FROM a),
    c AS (SELECT *, {kinds} AS k, {_group(stat)} AS o, {_group(name)} AS t,
                 {_group(condition)} AS e, {_group(value)} AS v FROM b),
    d AS (SELECT qid, question,
        CASE WHEN k IS NOT NULL THEN 'statistical' WHEN {visual} THEN 'visualization'
             WHEN {rows} THEN 'row_search' ELSE 'semantic' END AS query_type,
        replace(k, 'range_pair', 'range') AS pattern_type,
        CASE WHEN o IS NOT NULL THEN {_case([(f"o = '{a}'", f"'{b}'") for a, b in ops.items()])}
             WHEN k IN ('range', 'range_pair') THEN 'range' WHEN k = 'count' THEN 'count'
             WHEN k LIKE 'conditional_count_%' THEN 'conditional_count'
             WHEN k = 'superlative_salary' THEN
                 CASE WHEN regexp_matches(w, 'highest|most|maximum|top|best') THEN 'max' ELSE 'min' END
             WHEN k = 'superlative_age' THEN
                 CASE WHEN contains(w, 'oldest') THEN 'max' ELSE 'min' END
             WHEN k = 'superlative_performance' THEN
                 CASE WHEN regexp_matches(w, 'best|highest') THEN 'max' ELSE 'min' END END AS op,
        CASE WHEN k IN ('range', 'range_pair') THEN
                 CASE WHEN contains(t, 'age') THEN 'age'
                      WHEN contains(t, 'salary') OR contains(t, 'salaries') THEN 'salary'
                      WHEN contains(t, 'performance') THEN 'performance_rating'
                      ELSE regexp_replace(t, '^\\s+|\\s+$', '', 'g') END
             WHEN k = 'direct_stat_compound' THEN
                 CASE WHEN contains(t, 'performance') AND contains(t, 'rating')
                      THEN 'performance_rating'
                      WHEN contains(t, 'salary') OR contains(t, 'salaries') THEN 'salary'
                      ELSE replace(t, ' ', '_') END
             WHEN k LIKE 'conditional_count_%' OR k = 'superlative_age' THEN 'age'
             WHEN k = 'superlative_salary' THEN 'salary'
             WHEN k = 'superlative_performance' THEN 'performance_rating' ELSE t END AS target,
        e AS entity,
        CASE k WHEN 'conditional_count_greater' THEN '>' WHEN 'conditional_count_less' THEN '<'
               WHEN 'conditional_count_equal' THEN '==' END AS cond_op,
        TRY_CAST(v AS BIGINT) AS cond_value FROM c)
    SELECT *, CAST(CASE WHEN pattern_type = 'count' THEN 0.9
             WHEN pattern_type IN ('superlative_general', 'comparison') THEN 0.7
             WHEN pattern_type IS NOT NULL THEN 0.95 WHEN query_type = 'visualization' THEN 0.9
             WHEN query_type = 'row_search' THEN 0.8 ELSE 0.3 END AS DOUBLE) AS confidence FROM d
    """


TAGGED_SQL = _tagged_sql()


@query("classify_question", f"SELECT qid, query_type, pattern_type, confidence FROM ({TAGGED_SQL})")
def classify_question(spark: SparkSession, folder: str) -> DataFrame:
    return questions.tag_questions(question_log(spark, folder)).select(
        "qid", "query_type", "pattern_type", "confidence"
    )


@query(
    "extract_stat_op",
    f"SELECT qid, op, target FROM ({TAGGED_SQL}) WHERE query_type = 'statistical'",
)
def extract_stat_op(spark: SparkSession, folder: str) -> DataFrame:
    return (
        questions.tag_questions(question_log(spark, folder))
        .filter(F.col("query_type") == "statistical")
        .select("qid", "op", "target")
    )


@query(
    "extract_condition",
    f"SELECT qid, entity, target, cond_op, cond_value FROM ({TAGGED_SQL}) WHERE cond_op IS NOT NULL",
)
def extract_condition(spark: SparkSession, folder: str) -> DataFrame:
    return (
        questions.tag_questions(question_log(spark, folder))
        .filter(F.col("cond_op").isNotNull())
        .select("qid", "entity", "target", "cond_op", "cond_value")
    )


def _contains_any(parts: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains(w, {q(p)})" for p in parts) + ")"


_NORMAL_SQL = (
    "(SELECT qid, question, regexp_replace(lower(question), '^\\s+|\\s+$', '', 'g') AS w "
    f"FROM {QUESTIONS_SQL})"
)
_CHART_SQL = _case([(f"contains(w, '{c}')", f"'{c}'") for c in questions.CHART_TYPES])
_CHART_LIST = "[" + ", ".join(q(w) for w in questions.CHART_WORDS) + "]"


@query(
    "detect_viz_intent",
    f"""
    SELECT qid, {_contains_any(questions.CHART_WORDS)} AS is_visualization,
           CASE WHEN {_contains_any(questions.CHART_WORDS)} THEN coalesce({_CHART_SQL},
                CASE WHEN contains(w, 'vs') OR contains(w, 'versus') THEN 'scatter'
                     WHEN contains(w, 'distribution') THEN 'histogram'
                     WHEN contains(w, 'bar') OR contains(w, 'count') THEN 'bar'
                     ELSE 'histogram' END) END AS chart_type,
           CASE WHEN {_contains_any(questions.CHART_WORDS)} THEN
                array_to_string(list_transform(list_filter(regexp_split_to_array(w, '\\s+'),
                    lambda x: x <> '' AND NOT list_contains({_CHART_LIST}, x) AND length(x) > 2),
                    lambda x: regexp_replace(x, '^[().,!?]+|[().,!?]+$', '', 'g')), ' ')
                END AS candidate_columns
    FROM {_NORMAL_SQL}
    """,
)
def detect_viz_intent(spark: SparkSession, folder: str) -> DataFrame:
    return questions.detect_viz_intent(question_log(spark, folder)).drop("question")


@query(
    "detect_row_search",
    f"""
    SELECT qid, (({_contains_any(questions.ROW_WORDS)} OR {_contains_any(questions.ROW_PLACES)}
                  OR {_contains_any(questions.ROW_PHRASES)})
                 AND NOT {_contains_any(questions.NOT_ROW_STATS)}
                 AND NOT {_contains_any(questions.NOT_ROW_CHARTS)})
             OR (starts_with(w, 'show ') AND NOT {_contains_any(questions.NOT_ROW_CHARTS)}
                 AND {_contains_any(questions.SHOWN_PEOPLE)}) AS is_row_search
    FROM {_NORMAL_SQL}
    """,
)
def detect_row_search(spark: SparkSession, folder: str) -> DataFrame:
    return questions.detect_row_search(question_log(spark, folder)).drop("question")


def search_type_sql(text: str) -> str:
    scores = {
        name: " + ".join(f"regexp_matches(lower({text}), {q(p)})::INT" for p in patterns)
        for name, patterns in questions.SEARCH_PATTERNS.items()
    }
    best = f"greatest({', '.join(scores.values())})"
    return _case(
        [(f"{best} = 0", "'general'")] + [(f"({s}) = {best}", f"'{n}'") for n, s in scores.items()]
    )


def expand_sql(text: str) -> str:
    known = " ".join(
        f"WHEN {q(word)} THEN x || {q(' ' + ' '.join(others[:2]))}"
        for word, others in questions.SYNONYMS.items()
    )
    return (
        f"array_to_string(list_transform(list_filter(regexp_split_to_array(lower({text}), '\\s+'), "
        f"lambda x: x <> ''), lambda x: CASE x {known} ELSE x END), ' ')"
    )


@query(
    "classify_search_type",
    f"SELECT qid, {search_type_sql('question')} AS search_type FROM {QUESTIONS_SQL}",
)
def classify_search_type(spark: SparkSession, folder: str) -> DataFrame:
    return question_log(spark, folder).select(
        "qid", questions.search_type(F.col("question")).alias("search_type")
    )


@query("expand_query", f"SELECT qid, {expand_sql('question')} AS expanded FROM {QUESTIONS_SQL}")
def expand_query(spark: SparkSession, folder: str) -> DataFrame:
    return question_log(spark, folder).select(
        "qid", questions.expand_query(F.col("question")).alias("expanded")
    )


def _answers_sql() -> str:
    numbers = ("employee_id", "age", "salary", "performance_rating")
    texts = ("name", "department")
    stats = {
        "mean": "avg({c})",
        "median": "median({c})",
        "sum": "sum({c})",
        "count": "count({c})",
        "std": "stddev_samp({c})",
        "var": "var_samp({c})",
        "min": "min({c})",
        "max": "max({c})",
        "range": "min({c})",
    }
    facts = ["SELECT '' AS c, 'count' AS f, CAST(count(*) AS DOUBLE) AS v, NULL AS h, NULL AS n FROM s"]
    for c in numbers:
        for op, f in stats.items():
            high = f"CAST(max({c}) AS DOUBLE)" if op == "range" else "NULL"
            order = {"max": f"{c} DESC, employee_id", "min": f"{c}, employee_id"}.get(op)
            name = f"(SELECT name FROM s ORDER BY {order} LIMIT 1)" if order else "NULL"
            facts.append(
                f"SELECT '{c}', '{op}', CAST({f.format(c=c)} AS DOUBLE), {high}, {name} FROM s"
            )
    facts += [f"SELECT '{c}', 'count', CAST(count({c}) AS DOUBLE), NULL, NULL FROM s" for c in texts]
    columns = "['employee_id', 'name', 'age', 'salary', 'department', 'performance_rating']"
    singular = "regexp_replace(lower(target), 's$', '')"
    alias = (
        "CASE {k} WHEN 'salary' THEN 'salary' WHEN 'age' THEN 'age' WHEN 'name' THEN 'name' "
        "WHEN 'department' THEN 'department' WHEN 'performance' THEN 'performance_rating' "
        "WHEN 'performance_rating' THEN 'performance_rating' END"
    )
    partial = "list_filter({l}, lambda x: contains(x, {k}) OR contains({k}, x))[1]"
    mapped = (
        f"coalesce(list_filter({columns}, lambda x: x = lower(target) OR x = {singular})[1], "
        f"{alias.format(k='lower(target)')}, {alias.format(k=singular)}, "
        f"{partial.format(l=columns, k='lower(target)')}, {partial.format(l=columns, k=singular)})"
    )
    entity = " ".join(f"WHEN lower(entity) IN ('{c}', '{c}s') THEN '{c}'" for c in numbers)
    value = "CASE col " + " ".join(f"WHEN '{c}' THEN {c}" for c in numbers) + " END"
    return f"""
    WITH s AS (SELECT * FROM {STAFF_SQL}),
    t AS (SELECT * FROM ({TAGGED_SQL})),
    facts AS ({" UNION ALL ".join(facts)}),
    r AS (SELECT *, CASE WHEN op = 'conditional_count' THEN CASE {entity} ELSE {mapped} END
                         ELSE {mapped} END AS col FROM t),
    conds AS (SELECT DISTINCT col, cond_op, cond_value FROM r WHERE cond_op IS NOT NULL),
    counted AS (SELECT col, cond_op, cond_value,
                CAST(count(*) FILTER (WHERE CASE cond_op WHEN '>' THEN {value} > cond_value
                     WHEN '<' THEN {value} < cond_value ELSE {value} = cond_value END) AS DOUBLE) AS n
                FROM conds, s GROUP BY col, cond_op, cond_value),
    a AS (SELECT r.*, CASE WHEN r.op = 'conditional_count' THEN k.n ELSE f.v END AS answer,
                 f.h AS value_high, f.n AS row_name
          FROM r LEFT JOIN facts f ON f.f = r.op AND f.c =
               CASE WHEN r.op = 'count' AND r.col IS NULL THEN '' ELSE r.col END
          LEFT JOIN counted k ON k.col = r.col AND k.cond_op = r.cond_op
               AND k.cond_value = r.cond_value)
    SELECT qid, op, col AS "column", round(answer, 4) AS answer, value_high, row_name,
           CASE WHEN query_type <> 'statistical' THEN 'Routed to ' || query_type
                WHEN op IS NULL THEN 'Unsupported question' WHEN answer IS NOT NULL THEN NULL
                WHEN col IS NULL THEN 'Column ''' || target || ''' not found in dataset.'
                WHEN op = 'conditional_count' AND cond_value IS NULL THEN 'The number is out of range'
                ELSE 'Result is NaN - column ''' || col || ''' may contain non-numeric data' END
           AS message
    FROM a
    """


@query("answer_questions", _answers_sql())
def answer_questions(spark: SparkSession, folder: str) -> DataFrame:
    tagged = questions.tag_questions(question_log(spark, folder))
    answers = questions.answer_questions(tagged, staff(spark, folder), "name", "employee_id")
    return rounded(answers, "answer").select(
        "qid", "op", "column", "answer", "value_high", "row_name", "message"
    )
