"""Scores, terms and names whose values are known."""

from pyspark.sql import functions as F

from spanworks.functions import classify, paths, ranking
from spanworks.functions.requests import normalize
from spanworks.queries import QUERIES


def test_a_candidate_of_known_score(spark):
    request = normalize(spark, "Update docs/api/client.md for createClient --timeout timeout option", ["canonical_api_doc"])
    row = spark.createDataFrame(
        [("docs/api/client.md", "doc.paragraph", "canonical_api_doc", "Client API timeout option", "Client API Options", "createClient accepts --timeout and timeoutMs in the Client API.", 0.8,
          ["fts_lexical", "markdown_anchor", "path_role_expansion"], False, False, False, True, "low")],
        "path string, kind string, role string, label string, heading string, text string, linked double, routes array<string>, stale boolean, deprecated boolean, redacted boolean, covers boolean, risk string")
    got = ranking.ranked(row, request).first()
    parts = {k: got[k] for k in ranking.components(request)}
    assert list(parts.values()) == [20, 15, 10, 8, 50, 8, 6, 6, 4, 38, 11, 5, 0, 0, 0, 0, 0, 0]
    assert got.score == 181 and got.decision == "must_edit"


def test_terms_of_requests(spark):
    found = normalize(spark, "Update docs/api/client.md Client API for createClient --timeout and API_TIMEOUT from legacyTimeout to timeoutMs", ["canonical_api_doc", "tests"])
    assert "docs/api/client.md" in found["path"] and {"createClient", "legacyTimeout", "timeoutMs"} <= set(found["symbol"]) and {"--timeout", "API_TIMEOUT"} <= set(found["config"])
    assert {"client", "api"} <= set(found["doc"]) and "timeout" in found["feature"] and found["old"] == ["legacyTimeout"] and found["new"] == ["timeoutMs"]
    assert found["roles"] == ["canonical_api_doc", "test_file", "fixture_file"]
    assert normalize(spark, "a.oldName => b.newName in x")["old"] == ["a.oldName"] and "oldName" in normalize(spark, "a.oldName => b.newName")["symbol"]
    assert normalize(spark, "replace red fish with blue fish in ponds")["new"] == ["blue fish"] and normalize(spark, "run `tickedName`")["symbol"] == ["tickedName"]
    assert normalize(spark, "")["exact"] == [] and normalize(spark, "推进/规划 notes.md")["path"] == ["notes.md"]


def test_layers_roles_and_guards(spark):
    expected = {
        "src/app.ts": ("business", "source_file"), "dist/a.js": ("generated", "generated_file"), "a/vendor/b.py": ("vendor", "source_file"), "old-backup/x.md": ("backup", "design_doc"), "my_archive/x.py": ("archive", "source_file"),
        "repair-worktree/a.ts": ("repair_worktree", "source_file"), "logs/run.txt": ("artifact", "unknown"), ".claude/x.md": ("tooling_agent", "design_doc"), ".spanindex/spans": ("derived_state", "unknown"), "README.md": ("business", "readme_doc"),
        "docs/tutorials/a.md": ("business", "tutorial_doc"), "tests/data.bin": ("business", "test_file"), "x.schema.json": ("business", "schema_file"), "package.json": ("business", "package_metadata"), "app.min.js": ("generated", "generated_file"), "lib/test_x.py": ("business", "test_file")}
    rows = spark.createDataFrame([(p,) for p in expected], "path string").select("path", classify.layer(F.col("path")).alias("layer"), classify.role(F.col("path")).alias("role")).collect()
    assert {r.path: (r.layer, r.role) for r in rows} == expected
    secret = [".env", ".env.local", "a/.ssh/id", "k/id_rsa", "x.pem", "secrets.yml", "credentials", "a/.kube/config"]
    plain = ["env", "a.environment", "keys.md", "secretary.json", "my_id_rsa_notes"]
    got = {r.path for r in spark.createDataFrame([(p,) for p in secret + plain], "path string").where(classify.sensitive(F.col("path"))).collect()}
    assert got == set(secret)


def test_names_of_paths(spark):
    row = spark.createDataFrame([("src/check_run_limits_total.test.ts", "a//b/", "lib\\\\x/index")], "p string, q string, s string").select(
        paths.stem_aliases(F.col("p"), paths.SOURCE_PREFIXES).alias("aliases"), paths.trimmed(F.col("q")).alias("q"), paths.import_variants(F.col("s")).alias("variants"),
        paths.parent_name(F.lit("a.ts:Box.open")).alias("parent"), paths.symbol_path(F.lit("a.ts:Box.open")).alias("symbol"), paths.structured_tokens(F.lit("code.function_of-x")).alias("tokens")).first()
    assert {"check_run_limits_total", "run_limits_total", "limits_total"} <= set(row.aliases) and row.q == "a/b" and len(row.variants) == 15
    assert row.parent == "a.ts:Box" and row.symbol == ["Box", "open"] and row.tokens == ["code", "function"]


def test_every_code_span_of_a_label_is_linked(spark, tmp_path):
    docs = [(0, "alpha one"), (9, "alpha two"), (5, "beta"), (7, "see alpha and beta"), (1, "alpha alpha"), (6, "beta alone")]
    spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = lambda name: sorted((r.source_id, r.target_id) for r in QUERIES[name](spark, str(tmp_path)).collect())
    assert got("test_call_links") == [("span:7", "span:0"), ("span:7", "span:5"), ("span:7", "span:9")]
    assert got("inline_code_links") == [("span:1", "span:0"), ("span:1", "span:9"), ("span:6", "span:5")]


def test_a_kept_target_has_its_rank_among_all(spark, tmp_path):
    # The first costs 62, as the second, which does not fit beside it; the third, of 54, does.
    texts = ["onesen erblest inenan eranenes", "onesen erblest inenan eranenes", "onesen erblest inenan", "onesen"]
    rows = [(i, t, lang, "s", len(t)) for lang, at in (("en", 10), ("de", 20)) for i, t in enumerate(texts, at)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = sorted(tuple(r) for r in QUERIES["token_budget_greedy"](spark, str(tmp_path)).select("lang", "path", "n").collect())
    assert got == [("de", "s/de/20", 1), ("de", "s/de/22", 3), ("en", "s/en/10", 1), ("en", "s/en/12", 3)]
