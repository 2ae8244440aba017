"""Nested configurations as dotted keys."""

import pytest
from pyspark.sql import functions as F

from trackloom.plans import catalogue
from trackloom.functions.yaml_text import flat, nested_text
from trackloom.sources import configs

TEXT = '''a: 1  # c
b:
  - x
  - y: 2
    z: [1, "p, q", {k: v}]
  -
    w: 'it''s'
c:
- 1
- - 2
  - 3
d: {e: {f: 1}, g: []}
"q k": "a#b: \\"c\\""
url: http://x/y#z
e: ~
t: |
  line one
    two

next: >-
  folded
  text
b2:
  deep:
    er: yes
  back: 3
a: 5
'''
WANTED = {
    "b.0": "x", "b.1.y": "2", "b.1.z.0": "1", "b.1.z.1": "p, q", "b.1.z.2.k": "v", "b.2.w": "it's", "c.0": "1", "c.1.0": "2", "c.1.1": "3",
    "d.e.f": "1", "q k": 'a#b: "c"', "url": "http://x/y#z", "e": None, "t": "line one\n  two", "next": "folded text", "b2.deep.er": "yes", "b2.back": "3", "a": "5",
}


def test_blocks_lists_quotes_and_comments():
    assert flat(TEXT) == WANTED
    assert flat(nested_text(WANTED)) == WANTED
    assert flat("") == flat("# only\n---\n") == {} and nested_text({}) == ""
    assert flat("a:\n  b: 1\na: 2") == {"a": "2"} and flat("a: 2\na:\n  b: 1") == {"a.b": "1"}  # the last counts


@pytest.mark.parametrize("value", ["", " x", "a: b", "#", "- x", "null", "~", "it's", 'say "x"', "[1]", "tab\there", "back\\slash", "1.5e-3", "ünï"])
def test_values_come_back(value):
    assert flat(nested_text({"a.b": value, "a.c.0": value})) == {"a.b": value, "a.c.0": value}


def test_merging_below_the_top(spark):
    base = {"lr": "1", "net.depth": "2", "net.width": "3", "sizes.0": "8", "sizes.1": "9", "path": "p", "blocks.0.k": "1"}
    over = {"net.depth": "5", "sizes.0": "7", "path.sub": "q", "blocks": "none"}
    df = spark.createDataFrame([(base, over)], "base map<string,string>, over map<string,string>")
    (found,) = df.select(configs.merged(F.col("base"), F.col("over")).alias("m")).first()
    assert found == {"lr": "1", "net.width": "3", "net.depth": "5", "sizes.0": "7", "path.sub": "q", "blocks": "none"}


def test_rewriting_files(spark, tmp_path):
    for name, text in (("one/a.yaml", "lr: 1\nnet:\n  depth: 2\n"), ("two/b.yaml", "net: {width: 3}\n"), ("two/empty.yaml", "")):
        (tmp_path / "in" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "in" / name).write_text(text)
    override = F.create_map(F.lit("net.depth"), F.lit("9"))
    change = {("one/a.yaml", "net.depth", "2", "9"), ("two/b.yaml", "net.depth", None, "9")}
    dry = configs.rewrite_yaml(spark, str(tmp_path / "in"), str(tmp_path / "out"), override)
    assert {tuple(r) for r in dry.collect()} == change and not (tmp_path / "out").exists()
    done = configs.rewrite_yaml(spark, str(tmp_path / "in"), str(tmp_path / "out"), override, dry_run=False)
    assert {tuple(r) for r in done.collect()} == change
    held = sorted(sorted(r["config"].items()) for r in configs.read_yaml(spark, str(tmp_path / "out")).collect())
    assert held == [[("lr", "1"), ("net.depth", "9")], [("net.depth", "9"), ("net.width", "3")]]


def test_documents_of_a_file_are_read_and_rewritten_apart(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "all.yaml").write_text("# head\n---\nlr: 1\ntext: |\n  a\n  ---\n  b\n--- # second\nlr: 2\n...\n---\n")
    held = [r["config"] for r in configs.read_yaml(spark, str(tmp_path / "in")).collect()]
    assert held == [{"lr": "1", "text": "a\n---\nb"}, {"lr": "2"}]
    done = configs.rewrite_yaml(spark, str(tmp_path / "in"), str(tmp_path / "out"), F.create_map(F.lit("lr"), F.lit("2")), dry_run=False)
    assert [tuple(r) for r in done.collect()] == [("all.yaml", "lr", "1", "2")]
    held = [r["config"] for r in configs.read_yaml(spark, str(tmp_path / "out")).collect()]
    assert held == [{"lr": "2", "text": "a\n---\nb"}, {"lr": "2"}]


def test_trials_do_not_each_have_a_file(spark, tmp_path):
    from pathlib import Path

    rows = spark.range(3000).select(F.col("id").alias("user_id"), F.lit('{"k": 5}').alias("props"))
    rows.write.parquet(str(tmp_path / "events.parquet"))
    files = list(Path(catalogue._yaml_folder(spark, str(tmp_path)).removeprefix("file:")).rglob("*.txt"))
    assert len(files) <= 12
    assert catalogue.queries()["read_yaml"](spark, str(tmp_path)).count() == 3000
