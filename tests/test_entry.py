import ast
import subprocess
import sys
from pathlib import Path

import __spark_entry__

ROOT = Path(__spark_entry__.__file__).parent


def test_every_statement_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_entry_gives_rows(spark, small):
    found = __spark_entry__.queries()["ldu_chunking"](spark, small)
    assert found.columns == ["document_id", "ldu_id", "content_type", "text", "page", "token_count", "content_hash", "parent_section_id"]


def test_nothing_else_imports_the_llm_subpackage():
    for path in (ROOT / "quire").rglob("*.py"):
        if "llm" in path.relative_to(ROOT).parts:
            continue
        for node in ast.walk(ast.parse(path.read_text())):
            names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
            assert not any(n.startswith("quire.llm") for n in names), path


def test_entry_works_without_the_llm_subpackage(tmp_path):
    for name in ("quire", "__spark_entry__.py"):
        subprocess.run(["cp", "-r", str(ROOT / name), str(tmp_path)], check=True)
    subprocess.run(["rm", "-r", str(tmp_path / "quire" / "llm")], check=False)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'ldu_chunking' in q and 'pipeline' not in q and not any(k.startswith('op') for k in q); assert e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)


def test_membership_has_a_row_for_each_unit_of_each_section(spark, small):
    found = __spark_entry__.queries()["section_membership"](spark, small)
    assert found.columns == ["document_id", "section_id", "ldu_id"]
    assert found.count() == found.distinct().count() > 2 * found.select("document_id", "section_id").distinct().count()
