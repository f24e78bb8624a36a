"""Secrets behind other characters, in short and wrapped base64, and beside and inside large layers."""

from __future__ import annotations

import base64
import bz2
import gzip
import lzma
import random
import zlib

import pytest

from marketframe.llm import secrets

SECRET = "password = hunter2secret"


def _b64(data):
    return base64.b64encode(data).decode()


def _found(text):
    return {(kind, start, end) for kind, start, end in secrets.find(text)[1]}


@pytest.mark.parametrize("lead", ["//host/cb/", "key_", "x-", "ab", "abc/", "a/b/c/d-", "zZ9"])
@pytest.mark.parametrize("tail", ["", "/next/page", "-x"])
def test_base64_behind_other_characters(lead, tail):
    for data in (SECRET.encode(), b"token=secret1", zlib.compress(SECRET.encode()), gzip.compress(SECRET.encode()), bz2.compress(SECRET.encode()), lzma.compress(SECRET.encode())):
        packed = not data.startswith((b"p", b"t"))
        if packed and lead == "zZ9" and data[:1] == b"\x78":
            continue  # without a separator zlib's two header characters are tried as well, below
        body = _b64(data).rstrip("=")
        assert any(k == "assign" for k, _, _ in _found(f"see {lead}{body}{tail} end")), (lead, tail, data[:6])
    assert _found(f"zZ9{_b64(zlib.compress(SECRET.encode()))}")


def test_short_base64_word():
    assert _b64(b"token=secret") == "dG9rZW49c2VjcmV0"
    assert _found("a dG9rZW49c2VjcmV0 b") == {("assign", 2, 18)}


@pytest.mark.parametrize("width", [64, 76])
@pytest.mark.parametrize("newline", ["\n", "\r\n", "\n  "])
def test_wrapped_base64(width, newline):
    rng = random.Random(5)
    noise = " ".join(str(rng.random()) for _ in range(30))
    for data in (gzip.compress(f"{noise} {SECRET} {noise}".encode()), f"{'x' * (width * 3 // 4 - 12)} {SECRET}".encode()):
        body = _b64(data)
        text = "start\n" + newline.join(body[i:i + width] for i in range(0, len(body), width)) + "\nend"
        assert any(k == "assign" for k, _, _ in _found(text))


def test_layers_behind_and_inside_a_large_one(monkeypatch):
    monkeypatch.setattr(secrets, "MAX_LAYER", 3_000_000)
    rng = random.Random(6)
    filler = "".join(f"{rng.random()} " for _ in range(1000)) * 200
    plain = _b64(gzip.compress(filler.encode()))
    behind = f"{plain} {_b64(SECRET.encode())}"
    _, spans, _, oversize = secrets.find(behind)
    assert oversize == 1 and ("assign", len(plain) + 1, len(behind)) in spans
    for at in (100, 2_999_990, 3_400_000):
        large = _b64(gzip.compress((filler[:at] + f" {SECRET} " + filler[at:]).encode()))
        _, spans, _, oversize = secrets.find(f"a {large} b")
        assert oversize == 1 and ("assign", 2, 2 + len(large)) in spans, at


def test_members_in_a_row():
    data = gzip.compress(b"first member of two ") + gzip.compress(SECRET.encode())
    assert _found(_b64(data))
