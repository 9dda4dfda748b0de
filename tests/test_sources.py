"""Readers, catalogues, prompts and statements on small files."""

import json
import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from evalspark.operators import catalogue as c
from evalspark.operators import prep as p
from evalspark.operators.statements import run_statements
from evalspark.session import work_path
from evalspark.sources import catalogues, tables

ROOT = Path(__file__).parent.parent


def test_csv_log_keeps_lines_and_quotes(spark, tmp_path):
    (tmp_path / "my_model_results.csv").write_text(
        'id,question,true_query,generated_sql\n1,"two\nlines, ""quoted""",SELECT 1,\n2,plain,,"[SELECT 2]"\n')
    log = tables.read_query_log(spark, str(tmp_path / "my_model_results.csv")).orderBy("id").collect()
    assert log[0]["question"] == 'two\nlines, "quoted"' and log[0]["generated_sql"] is None and log[1]["true_query"] is None
    read = tables.read_result_dir(spark, str(tmp_path), tables.LOG_SCHEMA)
    assert {r["model"] for r in read.collect()} == {"my model"}
    with pytest.raises(ValueError):
        tables.read_query_log(spark, str(tmp_path / "my_model_results.csv"), required=("id", "valid_sql"))


def test_model_registry(spark, tmp_path):
    (tmp_path / "models.csv").write_text(
        "Model Name,Quant,Link,Path,Chosen,Chosen-2\nOne, Q5, https://a, one.gguf,1,0\nTwo, Q8,https://b,two.gguf,0,1\n")
    path = str(tmp_path / "models.csv")
    assert [(r["Model Name"], r["Quant"]) for r in tables.read_model_registry(spark, path, "Chosen").collect()] == [("One", "Q5")]
    assert [r["Path"] for r in tables.read_model_registry(spark, path, "Chosen-2").collect()] == ["two.gguf"]
    assert tables.read_model_registry(spark, path).count() == 2


def _clinical_catalogue(spark):
    """The 17 working tables as FIXTURES.md lists them."""
    text = (ROOT / "FIXTURES.md").read_text().split("Other inputs")[0]
    rows = []
    for name, columns in re.findall(r"^\| (\w+) \| \d+ \| (.+) \|$", text, re.M):
        columns = re.sub(r"\(.*?\)", "", columns)
        for i, col in enumerate(columns.split(",")):
            rows.append((name, col.split()[0], i, col.split()[1].rstrip("?")))
    return spark.createDataFrame(rows, "table string, column string, position int, type string")


def test_clinical_catalogue(spark):
    cat = _clinical_catalogue(spark).cache()
    assert cat.select("table").distinct().count() == 17 and cat.count() == 91
    classes = c.join_classes(cat)
    paths = c.join_paths(classes)
    assert paths.count() == 180
    assert {r["column"]: r["n"] for r in cat.groupBy("column").agg(F.count("*").alias("n")).collect()}["subject_id"] == 13
    assert c.tables_with_column(classes, "hadm_id").count() == 12 and c.tables_with_column(classes, "stay_id").count() == 4
    assert c.key_edges(cat).count() == 0
    assert [r["column"] for r in c.join_columns(classes, "d_items", "chartevents").collect()] == ["itemid"]
    summary = {r["table"]: r for r in c.schema_summary(cat).collect()}
    assert summary["d_icd_diagnoses"]["kind"] == "diagnosis records with ICD codes"
    assert summary["icustays"]["line"] == "- icustays table: Contains ICU stay information (key columns: subject_id, hadm_id, stay_id)"
    assert summary["transfers"]["kind"] == "related healthcare data"


def test_key_edges_by_singular_name(spark):
    cat = spark.createDataFrame([("patients", "patient_id"), ("visits", "patient_id"), ("visits", "visit_id")], "table string, column string")
    assert c.key_edges(cat).count() == 0
    got = {tuple(r) for r in c.key_edges(cat, singular=True).collect()}
    assert got == {("patients", "visits", "patient_id", "incoming"), ("visits", "patients", "patient_id", "outgoing")}


def test_schema_and_dictionary_json(spark, tmp_path):
    column = {"type": "int", "null": False, "primary_key": True, "foreign_key": False, "relation": "", "description": "a key"}
    (tmp_path / "s.json").write_text(json.dumps({
        "b.json": {"name": "b", "columns": {"z": column, "a": column}}, "a.json": {"name": "a", "columns": {"a": column}}}, indent=1))
    cat = catalogues.read_schema_catalog(spark, str(tmp_path / "s.json"))
    assert [(r["table"], r["column"]) for r in cat.orderBy("table_position", "position").collect()] == [("b", "z"), ("b", "a"), ("a", "a")]
    assert tuple(c.column_info(cat, "a", "a").first()) == ("int", "a key")
    (tmp_path / "d.json").write_text(json.dumps({"labs": [
        {"code_column": "itemid", "dict_table": "d_lab", "dict_code_column": "itemid", "dict_desc_column": "label"}]}))
    entries = catalogues.read_dictionary_map(spark, str(tmp_path / "d.json"))
    assert c.dictionary_info(entries, "labs").first()["dict_table"] == "d_lab"
    text = p.schema_text(cat)
    assert text.startswith("Tables:\n- b table: Contains related healthcare data\n- a table") and text.endswith(p.NOTES)


def test_sample_values(spark):
    rows = [(i % 7, None, f"s{i:03d}") for i in range(100)]
    df = spark.createDataFrame(rows, "a int, b string, c string").repartition(5)
    got = {}
    for r in c.sample_column_values(df, "t", 10).collect():
        got.setdefault(r["column"], []).append(r["value"])
    assert sorted(got["a"]) == [str(i) for i in range(7)] and got["b"] == [c.NO_VALUES]
    assert sorted(got["c"]) == [f"s{i:03d}" for i in range(10)]
    picked = [sorted(r["value"] for r in c.sample_column_values(df, "t", 10, seed=s).where("column = 'c'").collect()) for s in (1, 1, 2)]
    assert picked[0] == picked[1] != picked[2] and len(set(picked[0])) == 10 and set(picked[0]) <= {x[2] for x in rows}


def test_split_does_not_depend_on_partitions(spark):
    df = spark.range(5000)
    a = {tuple(r) for r in p.split(df).collect()}
    assert a == {tuple(r) for r in p.split(df.repartition(13)).collect()}
    assert 0.07 < sum(part == "validation" for _, part in a) / 5000 < 0.13


def test_prompts_without_sql_or_error(spark):
    df = spark.createDataFrame([("q", None, None, 0), ("q", "S", None, 0), ("q", "S", "bad", 2)], "question string, generated_sql string, error string, row_count int")
    texts = [r[0] for r in df.coalesce(1).select(p.few_shot_repair_prompt([])).collect()]
    assert texts[0] is None
    assert texts[1].endswith(f"Query: S\n{p.EMPTY_LINE}Correct query: ")
    assert texts[2].endswith("Query: S\nError: bad\nCorrect query: ")


def test_templates_are_arguments(spark):
    df = spark.createDataFrame([("q?", "S", "bad", 0)], "question string, generated_sql string, error string, row_count int")
    own = p.few_shot_repair_prompt(
        [{"question": "x", "original_sql": "y", "error": "", "fixed_sql": "z"}], "shop", template="{database}|{examples}|{question}|{query}|{error}|{empty}",
        example="{number}{question}{original_sql}{error}{fixed_sql};", error_line="<{error}>", empty_line="none")
    assert df.select(own).first()[0] == "shop|1xyz;|q?|S|<bad>|none"
    assert df.select(p.rendered("{a}{b} {a}", a=F.lit(None).cast("string"), b="{a}")).first()[0] == "{a} "


def test_run_statements(spark):
    spark.range(10).createOrReplaceTempView("numbers")
    rows = [
        ("ok", "SELECT id, id * 2 AS twice, id FROM numbers WHERE id > 6"), ("again", "SELECT id, id * 2 AS twice, id FROM numbers WHERE id > 6"),
        ("none", "SELECT * FROM numbers WHERE id < 0"), ("bad", "SELECT nope FROM numbers"), ("empty", ""), ("missing", None),
        ("comment", "-- how many\nSELECT id FROM numbers WHERE id > 7;"), ("word", "SELECT 'insert site' AS id FROM numbers"),
        ("from", "FROM numbers SELECT id"), ("with", "WITH n AS (SELECT id FROM numbers) SELECT id FROM n"),
        ("drop", "DROP VIEW numbers"), ("broken", "SELECT assert_true(false) FROM numbers"),
    ]
    statements = spark.createDataFrame(rows, "id string, true_query string")
    outcomes, result_rows = run_statements(statements, work_path(spark, "test-statements"), batch=2)
    got = {r["id"]: r for r in outcomes.collect()}
    assert {k: r["success"] for k, r in got.items()} == {
        "ok": True, "again": True, "none": True, "bad": False, "empty": False, "missing": True, "drop": False, "broken": False,
        "comment": True, "word": True, "from": True, "with": True}
    assert got["ok"]["row_count"] == got["again"]["row_count"] == 3 and got["none"]["row_count"] == 0
    assert got["empty"]["error"] == "No query provided" and "UNRESOLVED_COLUMN" in got["bad"]["error"]
    assert got["ok"]["result_columns"] == ["id", "twice", "id:1"] and "Range" in got["ok"]["execution_plan"]
    texts = [json.loads(r["row"]) for r in result_rows.where(F.col("statement") == got["ok"]["statement"]).collect()]
    assert sorted(t["twice"] for t in texts) == [14, 16, 18] and spark.catalog.tableExists("numbers")
