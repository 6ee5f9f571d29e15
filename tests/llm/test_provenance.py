import numpy as np
import pandas as pd
import pytest

from codeloom.llm import provenance as P

CODE = "import { a } from './b';\n\nexport function f(x) {\n  return a(x);\n}\n"
CASES = [
    ("src/a.js", CODE, None),
    ("src/vendor/lib/a.js", CODE, "vendored"),
    ("src/vendors/a.js", CODE, None),
    ("external_api/a.py", CODE, None),
    ("deps/kit-1.2.3/a.py", CODE, "vendored"),
    ("pkg/deps/resolver.go", CODE, None),
    ("src/external/client.py", CODE, None),
    ("src/a.generated.ts", CODE, "generated"),
    ("src/a_generator.ts", CODE, None),
    ("src/a_pb2.py", "x = 1\n", "generated"),
    ("src/a.min.js", "x", "minified"),
    ("src/a.go", "// Code generated by graphc. DO NOT EDIT.\n\npackage x\n", "generated"),
    ("src/a.go", 'package x\n\nconst b = "Code generated by graphc. DO NOT EDIT."\n', None),
    ("src/a.py", "# Helpers for generated ids; do not edit while the node runs.\nx = f()\n", None),
    ("src/a.py", "# Vendored from the core project, revision e8bc9d4922.\nx = f()\n", "vendored"),
    ("src/a.py", "# Emits the header of vendored files.\nx = f()\n", None),
    ("src/a.js", "// Lens 6.20\n// Released under a permissive licence.\nf();\n", "vendored"),
    ("src/a.js", "// Copyright (c) the Lens authors.\nf();\n", None),
    ("src/a.js", "!function(a){b(c.d)}(e);f=g&&h(i,7)?j.k:void 0;" * 20, "minified"),
    ("src/a.ts", "export const t = [\n" + '    ["k", 1.5, 22],\n' * 30 + "];\n", "data"),
    ("src/a.py", "import x\n\n\ndef f():\n    t = [" + "1234567, " * 400 + "]\n    return t\n", None),
    ("src/a.ts", "".join(f"export const Slot_{i:04d}_a = {i};\n" for i in range(40)), "generated"),
    (None, None, None),
    ("", "", None),
]


@pytest.mark.parametrize("path,text,kind", CASES)
def test_evidence(path, text, kind):
    assert P.evidence(path, text) == kind


def test_features_and_masking():
    path, text = "a/b.py", "# Code generated by x. DO NOT EDIT.\ny = 1\n"
    full, masked = P.features(path, text), P.features(path, text, masked=True)
    head = slice(P.BODY, P.BODY + P.HEAD)
    assert full[head].any() and not masked[head].any() and np.array_equal(full[: P.BODY], masked[: P.BODY])
    assert P.features(None, None).shape == (P.DIMENSIONS,)
    P.features("p", "x" * 300_000)


def test_the_machine_separates_what_is_separable():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 5)).astype(np.float32)
    y = np.where(x[:, 0] - 2 * x[:, 1] > 0, 1, -1)
    w = P.fit_svm(P.sparse(list(x)), y, width=5, epochs=20)
    assert (np.sign(x @ w) == y).mean() > 0.95


def test_tables(spark):
    kind = "file_id long, repo_id string, relative_path string, content string, origin_ string"
    rows = [(i, f"r{i % 7}", f"src/a{i}.js", CODE + f"// {i}\n", None) for i in range(80)] + [(100 + i, f"r{i % 7}", f"vendor/k{i}/a.js", CODE, None) for i in range(20)]
    rows += [(200, None, None, None, None), (201, "r1", "src/e.js", "", None), (201, "r1", "src/e.js", "", None)]
    files = spark.createDataFrame(rows, kind)
    judged = P.classify(files)
    assert judged.columns == [*files.columns, "hand_written", "svm_margin", "origin"]
    found = {r["file_id"] for r in judged.where("NOT hand_written").collect()}
    assert found == set(range(100, 120))
    assert P.classify(spark.createDataFrame([], kind)).count() == 0
    one = P.train(files).first()
    assert one["train_rows"] > 0 and one["valid_rows"] > 0


DATA, LARGER = "/root/testdata/sf0.01/source_files.parquet", "/root/testdata/sf0.1/source_files.parquet"


@pytest.fixture(scope="module")
def fitted():
    rows = pd.read_parquet(LARGER, columns=["file_id", "repo_id", "relative_path", "content"]).drop_duplicates("file_id").rename(columns={"relative_path": "path"})
    model = P._fit(rows)
    return rows, model, np.frombuffer(model["weights"], np.float32).reshape(len(P.KINDS), -1), np.array(model["thresholds"])


def test_validation_on_other_repositories(fitted):
    model = fitted[1]
    assert model["valid_rows"] > 50
    assert model["valid_precision"] >= 0.9 and model["valid_recall"] >= 0.9 and model["masked_recall"] >= 0.9


@pytest.mark.parametrize(
    "header",
    ["Generated by the protocol buffer compiler. DO NOT EDIT!", "Generated from Foo.g4 by ANTLR", "Generated by Django 4.2", "Generated by Cython 3.0.2", "A Bison parser, made by GNU Bison 3.8.2",
     "This file was generated by swagger-codegen", "THIS FILE IS GENERATED - DO NOT MODIFY", "DO NOT EDIT: autogenerated", "Code generated by counterfeiter. DO NOT EDIT."],
)
def test_public_headers_are_known(fitted, header):
    rows, _, weights, thresholds = fitted
    bodies = [P.split_header(t)[1] for p, t in zip(rows["path"], rows["content"], strict=True) if t and P.evidence(p, t) is None][:30]
    margins = [(weights @ P.features("src/a/b.py", f"# {header}\n{body}") - thresholds).max() for body in bodies]
    assert np.mean(np.array(margins) >= 0) > 0.9


def test_the_classifiers_decide(spark, monkeypatch):
    files = spark.read.parquet(DATA)
    fitted_rows = P.classify(files).where("NOT hand_written").count()
    real = P._fit
    monkeypatch.setattr(P, "train", lambda files, rows: spark.createDataFrame([{**real(pd.DataFrame({"path": [], "content": [], "repo_id": []})), "thresholds": [0.5] * 4, "weights": bytes(4 * 4 * P.DIMENSIONS)}], P.MODEL))
    assert fitted_rows > 20 and P.classify(files).where("NOT hand_written").count() == 0
