import pytest
from pyspark.sql import functions as F

from tabulary.operators import questions

CASES = [
    ("average salary", "statistical", "mean", "salary", 0.95),
    ("  Total AGE ", "statistical", "sum", "age", 0.95),
    ("mean of all salary", "statistical", "mean", "salary", 0.95),
    ("mean performance rating", "statistical", "mean", "performance_rating", 0.95),
    ("median head count", "statistical", "median", "head_count", 0.95),
    ("what is the minimum salary", "statistical", "min", "salary", 0.95),
    ("highest and lowest salary", "statistical", "range", "salary", 0.95),
    ("range of employee ages", "statistical", "range", "age", 0.95),
    ("what is the range of bonus", "statistical", "range", "bonus", 0.95),
    ("how many employees work here", "statistical", "count", None, 0.9),
    ("number of employees", "statistical", "count", None, 0.9),
    ("who is best paid", "statistical", "max", "salary", 0.95),
    ("who is the worst paid", "statistical", "min", "salary", 0.95),
    ("youngest employee in the company", "statistical", "min", "age", 0.95),
    ("worst performer", "statistical", "min", "performance_rating", 0.95),
    ("tallest person", "statistical", None, None, 0.7),
    ("salary above 30", "statistical", None, None, 0.7),
    ("plot the sales", "visualization", None, None, 0.9),
    ("show me all people where x", "visualization", None, None, 0.9),
    ("find all people that live here", "row_search", None, None, 0.8),
    ("explain this", "semantic", None, None, 0.3),
    ("", "semantic", None, None, 0.3),
]


# One question for each pattern of a statistic, with what must come out of it.
PATTERN_ROWS = [
    ("average salary", "direct_stat", "mean", "salary"),
    ("mean of all salary", "direct_stat_verbose", "mean", "salary"),
    ("median head count", "direct_stat_compound", "median", "head_count"),
    ("what is the salary range", "range", "range", "salary"),
    ("bonus range", "range", "range", "bonus"),
    ("range of employee ages", "range", "range", "age"),
    ("what is the range of bonus", "range", "range", "bonus"),
    ("what is range of bonus", "range", "range", "bonus"),
    ("salary range of staff", "range", "range", "salary"),
    ("min and max bonus", "range", "range", "bonus"),
    ("oldest and youngest people", "range", "range", "people"),
    ("lowest and highest salary", "range", "range", "salary"),
    ("total number of rows", "count", "count", None),
    ("how many people are older than 30", "conditional_count_greater", "conditional_count", "age"),
    ("how many people are under 30", "conditional_count_less", "conditional_count", "age"),
    ("how many people are equal to 30", "conditional_count_equal", "conditional_count", "age"),
    ("how many rows do we have", "count", "count", None),
    ("count all the rows", "count", "count", None),
    ("who is top paid", "superlative_salary", "max", "salary"),
    ("who earns the least pay", "superlative_salary", "min", "salary"),
    ("name the bottom paid worker", "superlative_salary", "min", "salary"),
    ("highest paid", "superlative_salary", "max", "salary"),
    ("lowest income", "superlative_salary", "min", "salary"),
    ("who is oldest", "superlative_age", "max", "age"),
    ("youngest worker", "superlative_age", "min", "age"),
    ("shortest person", "superlative_general", None, None),
    ("who has the worst rating", "superlative_performance", "min", "performance_rating"),
    ("best performer", "superlative_performance", "max", "performance_rating"),
    ("tell me what is the total bonus", "what_is_stat", "sum", "bonus"),
    ("bonus over 30", "comparison", None, None),
]


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "qid int, question string")


def test_tags(spark):
    rows = questions.tag_questions(frame(spark, [c[0] for c in CASES])).orderBy("qid").collect()
    got = [(r["question"], r["query_type"], r["op"], r["target"], r["confidence"]) for r in rows]
    assert got == CASES


def test_every_statistical_pattern(spark):
    rows = questions.tag_questions(frame(spark, [c[0] for c in PATTERN_ROWS])).orderBy("qid").collect()
    got = [(r["question"], r["pattern_type"], r["op"], r["target"]) for r in rows]
    assert got == PATTERN_ROWS
    assert {r["query_type"] for r in rows} == {"statistical"}


def test_every_other_pattern_and_word(spark):
    kinds = {
        "visualization": ["plot it", "create a scatter", "a pie chart"],
        "row_search": ["list all cars that run", "find people with dogs"],
        "semantic": ["show", "tell me more"],
    }
    texts = [text for group in kinds.values() for text in group]
    rows = questions.tag_questions(frame(spark, texts)).orderBy("qid").collect()
    assert [r["query_type"] for r in rows] == [kind for kind, group in kinds.items() for _ in group]
    searches = {
        "data_analysis": ["study it", "the stats", "a trend"],
        "column_search": ["an attribute", "what are the columns", "its schema"],
        "statistical": ["the mode", "a total", "each quartile"],
        "filter_search": ["select it", "it contains x", "between us"],
        "general": ["hello there"],
    }
    texts = [text for group in searches.values() for text in group]
    found = frame(spark, texts).select("qid", questions.search_type(F.col("question")).alias("kind"))
    wanted = [kind for kind, group in searches.items() for _ in group]
    assert [r["kind"] for r in found.orderBy("qid").collect()] == wanted
    wide = {
        "analyze": "analyze examine study",
        "statistics": "statistics stats statistical",
        "data": "data dataset information",
        "column": "column field attribute",
        "row": "row record entry",
        "correlation": "correlation relationship association",
        "distribution": "distribution spread pattern",
        "average": "average mean typical",
        "total": "total sum aggregate",
        "trend": "trend pattern direction",
        "outlier": "outlier anomaly exception",
        "missing": "missing null empty",
        "unique": "unique distinct different",
        "other words": "other words",
    }
    found = frame(spark, list(wide)).select("qid", questions.expand_query(F.col("question")).alias("w"))
    assert [r["w"] for r in found.orderBy("qid").collect()] == list(wide.values())
    charts = {
        "show the histogram": "histogram",
        "bar of x": "bar",
        "scatter of x": "scatter",
        "line of x": "line",
        "pie of x": "pie",
        "display a box": "box",
        "plot a vs b": "scatter",
        "graph the count": "bar",
        "chart it": "histogram",
        "nothing here": None,
    }
    found = questions.detect_viz_intent(frame(spark, list(charts))).orderBy("qid").collect()
    assert [r["chart_type"] for r in found] == list(charts.values())


def test_conditions(spark):
    texts = [
        "How many people are older than 30",
        "how many salary are under 5",
        "how many staff is equal to 7",
        "how many people are older than 99999999999999999999",
    ]
    rows = questions.tag_questions(frame(spark, texts)).orderBy("qid").collect()
    assert [(r["entity"], r["cond_op"], r["cond_value"]) for r in rows] == [
        ("people", ">", 30),
        ("salary", "<", 5),
        ("staff", "==", 7),
        ("people", ">", None),
    ]


@pytest.mark.parametrize(
    ("target", "columns", "wanted"),
    [
        ("salary", ["id", "Salary"], "Salary"),
        ("ages", ["percentage", "age"], "age"),
        ("age", ["percentage", "employee_age"], "employee_age"),
        ("salary", ["id", "yearly_income"], "yearly_income"),
        ("name", ["employee_id", "full_name"], "full_name"),
        ("price", ["unit_price", "price_total"], "unit_price"),
        ("bonus", ["id", "salary"], None),
    ],
)
def test_column_mapping(spark, target, columns, wanted):
    df = spark.createDataFrame([(target,)], "t string")
    assert df.select(questions.map_column_name(F.col("t"), columns)).first()[0] == wanted


HUGE = "how many employees are older than 99999999999999999999"


def test_answers(spark):
    staff = spark.createDataFrame(
        [
            (1, "Ann", 30, 100.0, "x"),
            (2, "Bob", 40, 300.0, "y"),
            (3, "Cy", 40, 300.0, "y"),
            (4, "Di", None, float("nan"), None),
        ],
        "employee_id int, name string, age int, salary double, department string",
    )
    asked = {
        "average salary": (700 / 3, None),
        "count salary": (3.0, None),
        "how many rows": (4.0, None),
        "how many people are older than 30": (2.0, None),
        "how many people are exactly 30": (1.0, None),
        "how many salary are below 200": (1.0, None),
        "who is the highest paid": (300.0, "Bob"),
        "lowest paid person": (100.0, "Ann"),
        "median age": (40.0, None),
    }
    tagged = questions.tag_questions(frame(spark, [*asked, "mean department", "sum bonus", "plot x", HUGE]))
    rows = {
        r["question"]: r
        for r in questions.answer_questions(tagged, staff, "name", "employee_id").collect()
    }
    for text, (value, name) in asked.items():
        assert rows[text]["answer"] == pytest.approx(value), text
        assert rows[text]["row_name"] == name, text
    assert "non-numeric" in rows["mean department"]["message"]
    assert "not found" in rows["sum bonus"]["message"]
    assert rows["plot x"]["message"] == "Routed to visualization"
    assert rows[HUGE]["message"] == "The number is out of range"


def test_search_type_and_expansion(spark):
    texts = ["Analyze the correlation", "list columns", "max and min outlier", "where x", "hello", ""]
    df = frame(spark, texts).select(
        "qid",
        questions.search_type(F.col("question")).alias("kind"),
        questions.expand_query(F.col("question")).alias("wide"),
    )
    rows = df.orderBy("qid").collect()
    assert [r["kind"] for r in rows] == [
        "data_analysis",
        "column_search",
        "statistical",
        "filter_search",
        "general",
        "general",
    ]
    assert rows[0]["wide"] == "analyze examine study the correlation relationship association"
    assert rows[5]["wide"] == ""


def test_chart_and_row_intent(spark):
    texts = ["Show the distribution of (age)!", "salary vs age graph", "average age", "show employees"]
    charts = questions.detect_viz_intent(frame(spark, texts)).orderBy("qid").collect()
    assert [r["chart_type"] for r in charts] == ["histogram", "scatter", None, "histogram"]
    assert charts[0]["candidate_columns"] == "the age"
    rows = questions.detect_row_search(frame(spark, texts)).orderBy("qid").collect()
    assert [r["is_row_search"] for r in rows] == [True, False, False, True]
