"""Generated, minified or vendored source files (problem 1).

Four linear support-vector classifiers (generated, vendored, minified, data) over hashed features
tell files that no one wrote by hand for their repository: character n-grams of the body, character
n-grams of the leading comment, and path components. A file is not hand-written if a classifier
puts it above its threshold; nothing else decides.

They are fitted on a bounded sample of the files, whose labels come from giveaways (``evidence``:
phrases of generators in the leading comment, vendor directories, names of build products, bodies
that are one table or one squeezed line), and on the headers of ``HEADERS``, a fixed set of public
generators' and vendors' headers and of hand-written look-alikes, each put before bodies of the
sample. Each file also enters once with its leading comment masked, so that the body and the path
have to carry the decision where the comment says nothing. Validation is split by repository: no
repository is on both sides. The thresholds are those of the best F1 on the validation side.

Defined results: null and empty content is judged by its path alone; a null path counts as an
empty one; a file walked twice gets the same verdict twice; an empty table gives an empty result;
a sample without any positive file gives classifiers that know the headers only. Input columns pass
through unchanged, new ones are ``hand_written``, ``svm_margin`` (above the threshold), ``origin``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BODY, HEAD, PATH = 4096, 8192, 4096
DIMENSIONS = BODY + HEAD + PATH + 1
KINDS = ("generated", "vendored", "minified", "data")

#: Bound of the labelled sample that the classifiers are fitted on (rows, chosen by hash of the id).
TRAINING_ROWS = 4000

# Headers of public generators, of vendored copies, and of hand-written files that speak of such things.
HEADERS = {
    "generated": [
        "Code generated by protoc-gen-go. DO NOT EDIT.", "Generated by the protocol buffer compiler.  DO NOT EDIT!", "Code generated by mockery v2.14.0. DO NOT EDIT.",
        "Code generated by \"stringer -type=Kind\"; DO NOT EDIT.", "Generated from Expr.g4 by ANTLR 4.9.2", "Generated by Django 4.2 on 2023-05-01 10:22", "Generated by Cython 0.29.21",
        "A Bison parser, made by GNU Bison 3.0.4.", "A lexical scanner generated by flex", "This file was generated by swagger-codegen.", "This class is auto generated by OpenAPI Generator",
        "THIS FILE IS GENERATED - DO NOT MODIFY", "DO NOT EDIT: autogenerated", "AUTOGENERATED FILE. ALL CHANGES WILL BE LOST.", "@generated SignedSource<<0a1b2c3d>>", "@generated by the schema compiler",
        "<auto-generated>", "Autogenerated by Thrift Compiler (0.13.0)", "automatically generated by rust-bindgen 0.59.1", "This file is automatically generated. Do not edit it.",
        "This file was automatically produced from schema.idl", "Do not edit by hand: rebuilt from the schema", "Any manual change will be lost.", "Generated by gRPC. Changes will be overwritten.", "source: user.proto",
    ],
    "vendored": [
        "Vendored from the upstream project, revision 1a2b3c4d5e.", "Copied from the upstream project at version 2.1.0; do not change here.", "Local copy of the library; send changes upstream.", "Bundled third-party source",
        "Imported verbatim from the upstream repository", "jQuery JavaScript Library v3.4.1\nReleased under the MIT license", "Underscore.js 1.8.3\n(c) 2009 the authors\nMay be freely distributed under the MIT licence.",
        "Widget 4.2\nReleased under a permissive licence", "Third-party code. Synced from upstream; do not modify.",
    ],
    "hand": [
        "Helpers for generated ids; do not edit while the node runs.", "Emits the header of vendored files.", "Copyright (c) the project authors.", "Writes the generated code of the compiler.",
        "Parses files that were generated by protoc.", "Written by hand, unlike the generated parser next door.", "This module generates the lookup tables.", "Reads the vendor list.",
        "Detects minified bundles and generated sources.", "Do not edit the cache while a run is open.", "Licensed under the MIT licence.", "Keeps copies of upstream rows.", "Checks that third-party hosts are up.",
    ],
}

_GENERATED = re.compile(
    r"code generated by .{0,80}do not edit|@generated\b|<auto-?generated|\bauto-?generated (?:file|on|by|from)|automatically (?:produced|generated|created) (?:from|by)"
    r"|do not (?:modify|edit) by hand: (?:re)?built|^[^\w\n]*source: \S+\.(?:proto|schema|idl|thrift|fbs|avsc|graphql|yaml|json)\b|schema hash [0-9a-f]{8,}|this file (?:is|was) (?:automatically |auto-?)(?:generated|produced)",
    re.I | re.M,
)
_VENDORED = re.compile(
    r"\bvendored from\b|bundled third[- ]party source|imported verbatim from|\blocal copy of .{0,80}upstream|send changes upstream|^[^\w\n]*[\w. -]{2,40}\d+\.\d+[\s\S]{0,40}^[^\w\n]*released under an? [\w-]+ licen[cs]e",
    re.I | re.M,
)
_VENDOR_PATH = re.compile(r"(?:^|/)(?:vendor|third[_-]?party|node_modules|bower_components|site-packages|vendored|contrib/bundled|(?:external|deps)(?=/[^/]+/))/", re.I)
_GENERATED_NAME = re.compile(r"(?:\.min|[._](?:pb|pb2|gen|generated|g)|_grpc_pb2?|_string(?=\.go)|\.designer|zz_generated\.[\w.]+)\.\w+$", re.I)
_BANNER = re.compile(r"/\*![\s\S]*?\*/|//# sourceMappingURL=.*")
_DATA_LINE = re.compile(r"[\[({]*+(?:(?:&?\"[^\"]*\"|'[^']*'|-?0x[\da-fA-F]+|-?[\d.]+(?:e-?\d+)?|true|false|null|None|nil)[\])}]*+,?\s*+[\[({]*+)*+[\])}]*+[;,]?")
_TABLE_NAME = re.compile(r"(?:[\w$]*[A-Za-z]+_?[0-9a-f]{3,}_?\w*|_?[a-z]+_?[0-9a-f]{3,8})\b(?: \w+| ?: ?[\w&' ]+)? ?= ?-?\d+;?$")
_COMMENT_LINE = re.compile(r"\s*(?://|#(?!\s*(?:include|define|pragma|if|ifdef|ifndef|endif|else|undef|\[|!\[))|<!--)")

# Ends of the names of generated and minified files.
NAMES = {"generated": [".pb", "_pb", "_pb2", "_pb2_grpc", "_gen", ".gen", ".generated", "_generated", ".g", "_string", ".designer"], "minified": [".min"]}


def split_header(text: str) -> tuple[str, str]:
    """Leading comment (line comments and block comments before the first code) and the rest."""
    at, n = 0, len(text)
    while at < n:
        while at < n and text[at] in " \t\r\n﻿":
            at += 1
        if text.startswith("/*", at):
            end = text.find("*/", at + 2)
            if end < 0:
                return text, ""
            at = end + 2
        elif _COMMENT_LINE.match(text, at):
            end = text.find("\n", at)
            if end < 0:
                return text, ""
            at = end + 1
        else:
            break
    return text[:at], text[at:]


def minified(body: str) -> bool:
    """Squeezed code: hardly any blanks, statements run on within long lines."""
    body = _BANNER.sub("", body).strip()
    if len(body) < 300:
        return False
    blanks = sum(map(body.count, " \t\n"))
    marks = body.count(";") + body.count("{") + body.count("}")
    return blanks < 0.08 * len(body) and marks > 0.02 * len(body) and len(body) / (body.count("\n") + 1) > 120


def holds_data(body: str) -> bool:
    """Nearly all lines are literals of one table."""
    lines = [x for x in map(str.strip, body.split("\n")) if x]
    if len(lines) < 8:
        return False
    table = [x for x in lines if x[0] in "[({\"'-0123456789])}&"]
    if len(table) <= 0.8 * len(lines):
        return False
    return sum(bool(_DATA_LINE.fullmatch(x)) for x in table) > 0.8 * len(lines)


def evidence(path: str | None, text: str | None) -> str | None:
    """Label of a training file: what shows that it is not hand-written here, or null."""
    path, text = (path or "").replace("\\", "/"), (text or "").replace("\r\n", "\n").replace("\r", "\n")
    head, body = split_header(text)
    if _VENDOR_PATH.search(path) or _VENDORED.search(head):
        return "vendored"
    if _GENERATED_NAME.search(path):
        return "minified" if ".min." in path.lower() else "generated"
    if _GENERATED.search(head):
        return "generated"
    if minified(body):
        return "minified"
    if holds_data(body):
        return "data"
    lines = [x for x in map(str.strip, body.split("\n")) if x]
    named = [x for x in lines if len(x) < 120 and x.rstrip(";")[-1:].isdigit()]
    if len(lines) > 12 and len(named) > 0.6 * len(lines) and sum(bool(_TABLE_NAME.search(x)) for x in named) > 0.6 * len(lines):
        return "generated"
    return None


def _grams(data: np.ndarray, sizes: tuple[int, ...], bins: int) -> np.ndarray:
    out = np.zeros(bins, np.float32)
    for size in sizes:
        if len(data) < size:
            continue
        code = data[: len(data) - size + 1].copy()
        for k in range(1, size):
            code *= np.uint32(0x01000193)
            code += data[k : len(data) - size + 1 + k]
        code *= np.uint32(2654435761)
        out += np.bincount(code >> np.uint32(32 - bins.bit_length() + 1), minlength=bins)[:bins]
    np.log1p(out, out=out)
    norm = float(np.sqrt(out @ out))
    return out / norm if norm else out


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-8", "ignore"), np.uint8).astype(np.uint32)


_DIGITS = str.maketrans("123456789", "000000000")


def _fnv(word: str) -> int:
    h = 2166136261
    for b in word.encode("utf-8", "ignore"):
        h = (h ^ b) * 16777619 & 0xFFFFFFFF
    return h


def features(path: str | None, text: str | None, masked: bool = False) -> np.ndarray:
    """Hashed feature vector; ``masked`` leaves out the leading comment."""
    path, text = (path or "").replace("\\", "/").lower(), text or ""
    head, body = split_header(text)
    out = np.zeros(DIMENSIONS, np.float32)
    out[:BODY] = _grams(_codes(body.translate(_DIGITS)), (3, 5), BODY)
    if not masked and head.strip():
        out[BODY : BODY + HEAD] = 2 * _grams(_codes(" ".join(_LETTERS.findall(head.lower().translate(_DIGITS)))), (4, 8), HEAD)
    parts = path.split("/")
    words = {f"d:{p}/" for p in parts[:-2]} | {f"l:{p}" for p in parts[-2:-1]} | set(re.findall(r"[._-][a-z0-9]+", parts[-1].translate(_DIGITS)))
    for word in words:
        out[BODY + HEAD + _fnv(word) % PATH] = 1.0
    out[-1] = 1.0
    return out


_LETTERS = re.compile(r"[^\W_]+|[^\w\s*/#-]")


class Rows(NamedTuple):
    """Sparse rows: places and values."""

    at: list[np.ndarray]
    value: list[np.ndarray]


def sparse(vectors: list[np.ndarray]) -> Rows:
    at = [np.flatnonzero(v) for v in vectors]
    return Rows(at, [v[k] for v, k in zip(vectors, at, strict=True)])


def fit_svm(x: Rows, y: np.ndarray, width: int = DIMENSIONS, cost: float = 4.0, epochs: int = 8, seed: int = 7) -> np.ndarray:
    """Linear L2-loss support-vector machine by dual coordinate descent. y is -1 or 1; 0 is left out."""
    w, alpha = np.zeros(width, np.float32), np.zeros(len(y))
    weight = np.where(y > 0, cost * max(1.0, (y < 0).sum() / max(1, (y > 0).sum())) ** 0.5, cost)
    diagonal = 1 / (2 * weight)
    squares = np.array([float(v @ v) for v in x.value]) + diagonal
    used = np.flatnonzero(y)
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(used):
            at, value = x.at[i], x.value[i]
            gradient = y[i] * float(w[at] @ value) - 1 + diagonal[i] * alpha[i]
            new = max(alpha[i] - gradient / squares[i], 0.0)
            if new != alpha[i]:
                w[at] += np.float32((new - alpha[i]) * y[i]) * value
                alpha[i] = new
    return w


def _scores(w: np.ndarray, x: Rows) -> np.ndarray:
    return np.array([float(w[at] @ value) for at, value in zip(x.at, x.value, strict=True)])


def _best_threshold(margin: np.ndarray, truth: np.ndarray) -> float:
    """Middle of the gap at which F1 is best; 0 without true rows."""
    if not truth.any():
        return 0.0
    order = np.argsort(-margin, kind="stable")
    hits = np.cumsum(truth[order])
    f1 = 2 * hits / (np.arange(1, len(order) + 1) + truth.sum())
    best = int(np.flatnonzero(f1 == f1.max())[-1])
    low = margin[order[best + 1]] if best + 1 < len(order) else margin[order[best]] - 1.0
    return float(np.clip((margin[order[best]] + low) / 2, -0.9, 0.9))


MODEL = (
    "weights binary, thresholds array<double>, train_rows long, valid_rows long, valid_precision double, valid_recall double, valid_f1 double, "
    "masked_rows long, masked_recall double"
)

_STYLES = ("// {}\n", "# {}\n", "/*\n * {}\n */\n", "/** {} */\n")


def _fit(rows: pd.DataFrame) -> dict:
    texts = [(t or "").replace("\r\n", "\n").replace("\r", "\n") for t in rows["content"]]
    kinds = [evidence(p, t) for p, t in zip(rows["path"], texts, strict=True)]
    held = [_fnv(r or "") % 5 == 0 for r in rows["repo_id"]]
    learn, known, check, hidden = [], [], [], []
    plain = []  # hand-written files of the training side, to be put behind headers
    for path, text, kind, valid in zip(rows["path"], texts, kinds, held, strict=True):
        body = split_header(text)[1]
        seen = kind is None or evidence(path, body) is not None
        if valid:
            check.append((features(path, text), kind))
            if kind and seen:
                hidden.append((features(path, text, masked=True), kind))
            continue
        learn.append(features(path, text))
        known.append(kind)
        if seen:
            learn.append(features(path, text, masked=True))
            known.append(kind)
        if kind is None and body.strip():
            plain.append((path, body))
    shown = [(kind, header) for kind, headers in HEADERS.items() for header in headers]
    for k in range(len(shown) * len(_STYLES) * 2):
        kind, header = shown[k % len(shown)]
        style = _STYLES[k // len(shown) % len(_STYLES)]
        path, body = plain[k * 7919 % len(plain)] if plain else ("", "")
        learn.append(features(path, style.format(header.replace("\n", "\n * " if "*" in style else "\n" + style[:2])) + body))
        known.append(None if kind == "hand" else kind)
    for kind, names in NAMES.items():
        for k, name in enumerate(name for name in names for _ in _STYLES):
            path, body = plain[k * 104729 % len(plain)] if plain else ("a/b.go", "")
            stem, dot, suffix = (path or "").rpartition(".")
            learn.append(features(f"{stem}{name}{dot}{suffix}", body))
            known.append(kind)
    x, judged = sparse(learn), sparse([v for v, _ in check])
    weights, thresholds = [], []
    for kind in KINDS:
        w = fit_svm(x, np.array([1 if k == kind else -1 if k is None else 0 for k in known]))
        usable = [i for i, (_, k) in enumerate(check) if k is None or k == kind]
        margin = _scores(w, judged)[usable]
        thresholds.append(_best_threshold(margin, np.array([check[i][1] == kind for i in usable], bool)))
        weights.append(w)

    def chosen(vectors: Rows) -> np.ndarray:
        if not vectors.at:
            return np.zeros(0, bool)
        return np.array([_scores(w, vectors) - t for w, t in zip(weights, thresholds, strict=True)]).max(axis=0) >= 0

    truth, found = np.array([k is not None for _, k in check], bool), chosen(judged)
    hit = int((found & truth).sum())
    precision, recall = hit / max(1, int(found.sum())), hit / max(1, int(truth.sum()))
    f1 = 2 * precision * recall / max(1e-9, precision + recall)
    masked = chosen(sparse([v for v, _ in hidden]))
    return {
        "weights": np.array(weights, np.float32).tobytes(), "thresholds": thresholds, "train_rows": len(learn), "valid_rows": len(check),
        "valid_precision": precision, "valid_recall": recall, "valid_f1": f1, "masked_rows": len(masked), "masked_recall": float(masked.mean()) if len(masked) else 0.0,
    }


def train(files: DataFrame, rows: int = TRAINING_ROWS) -> DataFrame:
    """One row with the fitted classifiers (see MODEL); the sample is bounded by ``rows``."""
    share = min(1.0, 1.1 * rows / max(1, files.count()))
    sample = (
        files.where(F.pmod(F.xxhash64("file_id"), F.lit(1 << 30)) < int(share * (1 << 30)))
        .select("file_id", "repo_id", F.col("relative_path").alias("path"), "content")
        .limit(rows)
    )

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = [b for b in batches if len(b)]
        table = pd.concat(parts) if parts else pd.DataFrame({"path": [], "content": [], "repo_id": []})
        table = table.drop_duplicates("file_id") if len(table) else table
        yield pd.DataFrame([_fit(table)])

    return sample.coalesce(1).mapInPandas(fit, MODEL)


def classify(files: DataFrame, rows: int = TRAINING_ROWS) -> DataFrame:
    """Input plus the verdict. The model (260 kB, of fixed size) is the only thing that is sent out."""
    model = train(files, rows).collect()
    weights = np.frombuffer(model[0]["weights"], np.float32).reshape(len(KINDS), DIMENSIONS) if model else np.zeros((len(KINDS), DIMENSIONS), np.float32)
    thresholds = np.array(model[0]["thresholds"] if model else [1.0] * len(KINDS))

    @F.pandas_udf("struct<svm_margin:double, origin:string>")
    def judge(path: pd.Series, text: pd.Series) -> pd.DataFrame:
        out = []
        for p, t in zip(path, text, strict=True):
            over = weights @ features(p, (t or "").replace("\r\n", "\n").replace("\r", "\n")) - thresholds
            best = int(over.argmax())
            out.append((float(over[best]), KINDS[best] if over[best] >= 0 else None))
        return pd.DataFrame(out, columns=["svm_margin", "origin"])

    judged = files.withColumn("_cl_verdict", judge("relative_path", "content"))
    return judged.select(
        *files.columns,
        F.col("_cl_verdict.origin").isNull().alias("hand_written"),
        F.col("_cl_verdict.svm_margin").alias("svm_margin"),
        F.col("_cl_verdict.origin").alias("origin"),
    )
