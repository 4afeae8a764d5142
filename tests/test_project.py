"""A small project, indexed, asked, changed and refreshed."""

from __future__ import annotations

import os

import pytest

from textquarry.project import Project

SOURCES = {
    "app/login.py": 'from app.store import Store\n\n\ndef login_user(name):\n    """Checks a user and opens a session."""\n    store = Store("users")\n    return store.find(name)\n',
    "app/store.py": 'class Store:\n    """Keeps rows in a database table."""\n\n    def __init__(self, table):\n        self.table = table\n\n    def find(self, key):\n        return query_database(self.table, key)\n\n\ndef query_database(table, key):\n    return (table, key)\n',
    "web/view.ts": "export function renderView(model) {\n  return fetch('/api/v1/users/list', { body: model })\n}\n",
    "README.md": "# Users\n\nHow a user signs in.\n",
}


@pytest.fixture(scope="module")
def project(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("demo")
    for name, text in SOURCES.items():
        os.makedirs(os.path.dirname(f"{root}/{name}") or root, exist_ok=True)
        (root / name).write_text(text)
    p = Project(spark, str(root), str(tmp_path_factory.mktemp("store")))
    assert p.index()["files"] == 4
    return p


def test_ask(project):
    assert project.text_search("database query").first().path == "app/store.py"
    assert project.symbol_lookup("login_user").first().name == "login_user"
    assert [(r.file_path, r.caller) for r in project.find_callers("query_database").collect()] == [("app/store.py", "find")]
    nodes, edges = project.trace_call_graph("query_database", direction="upstream")
    assert {r.name for r in nodes.collect()} == {"query_database", "find", "login_user"} and edges.count() >= 1
    assert [r.target_file for r in project.import_graph("app/login.py").collect()] == ["app/store.py"]
    assert [r.source_file for r in project.find_importers("app/store.py").collect()] == ["app/login.py"]
    assert [r.line_number for r in project.grep("query_database", limit=5).collect()] == [8, 11]
    assert project.protocol_search("users").first().endpoint == "/api/v1/users/list"
    assert project.pattern_search("Store($X)").count() == 1


def test_meaning(project):
    found = project.semantic_search("query database table key", limit=3).collect()
    assert found[0].file_path == "app/store.py" and [r["rank"] for r in found] == [1, 2, 3]
    assert project.semantic_search("render view", mode="code", limit=1, language="typescript").first().symbol_name == "renderView"
    assert project.structured_search("lex: login user\nvec: session", limit=2).first().file_path == "app/login.py"
    anchors, related = project.semantic_bundle("login user session", anchors=1)
    assert anchors.first().file_path == "app/login.py" and "app/store.py" in {r.file_path for r in related.collect()}
    assert project.retrieve_context("where is `query_database` defined?")[0] == "symbol"
    assert "points" in project.instructions()


def test_refresh(project):
    assert project.refresh() == {"added_or_changed": 0, "removed": 0}
    path = f"{project.root}/app/extra.py"
    with open(path, "w") as f:
        f.write("def extra_helper():\n    return renderView\n")
    os.remove(f"{project.root}/README.md")
    assert project.refresh() == {"added_or_changed": 1, "removed": 1}
    assert project.symbol_lookup("extra_helper").first().file_path == "app/extra.py" and project.info()["files"] == 4
    assert project.text_search("extra helper").first().path == "app/extra.py" and project.text_search("signs").collect() == []
    assert project.cache_status() == {"cached": 4, "unchanged": 4}


def test_contexts(project):
    """Each way of answering gives rows, with what stands beside them."""
    semantic = project.retrieve_context("who imports the store", limit=2)
    assert semantic.mode == "semantic" and semantic.results.count() == 2 and "file_path" in semantic.related.columns
    text = project.text_context("database table key query", limit=1)
    assert text.mode == "text" and text.results.first().file_path == "app/store.py" and "app/login.py" in {r.file_path for r in text.related.collect()}
    anchors, _ = project.semantic_bundle("query database table key", anchors=1)
    assert anchors.count() == 1
    symbol = project.retrieve_context("how does `query_database` work", limit=3)
    assert symbol.mode == "symbol" and symbol.results.first().name == "query_database"
