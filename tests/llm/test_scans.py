"""Packing, license, decontamination, secret and quality operators against plain versions."""

import base64
import hashlib
import json
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from loomspace.llm import _text, decontamination, licences, packing, quality, secrets

BPE = public_tokenizers.path("byte_bpe_50k.json")
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
EDGE = [(900, None), (901, ""), (902, " \n"), (902, " \n"), (None, "x y"), (903, "Ab-cD é\x00z " * 5000)]
DOC = "doc_id long, text string"


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def frame(spark, docs):
    return spark.createDataFrame(docs, DOC)


# packing


def test_pieces_are_the_tokenizers_ids(spark):
    r = random.Random(0)
    texts = ["".join(r.choice("the a éß 1\n'sll<>|😀梦\x1c\xa0") for _ in range(r.randrange(4000))) for _ in range(40)] + ["a<|endoftext|>b"]
    docs = EDGE + [(k, t) for k, t in enumerate(texts)]
    rows = packing.pack_documents(frame(spark, docs), BPE, keep_ids=True).collect()
    t = Tokenizer.from_file(BPE)
    want = Counter()
    for d, x in docs:
        ids = np.array(t.encode(x or "", add_special_tokens=False).ids + [0], "<u4")
        for s in range(0, len(ids), 1024):
            want[d, s, len(ids[s : s + 1024]), zlib.crc32(ids[s : s + 1024].tobytes()), len(ids)] += 1
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in rows) == want
    by = {}
    for x in rows:
        by.setdefault(x.sequence_id, []).append((x.offset, x.length))
    for parts in by.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= 1024
    used = sum(x.length for x in rows)
    assert used / (1024 * len(by)) > 0.9
    assert packing.pack_documents(frame(spark, []), BPE).collect() == []


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 500), max_size=30))
def test_patterns_hold_every_piece(histogram):
    packs = packing.patterns(histogram, 64)
    held = Counter()
    for pack, n in packs:
        assert sum(pack) <= 64 and n > 0
        for size in pack:
            held[size] += n
    assert held == Counter(histogram)
    keys, sequence, offset = packing.slots(packs)
    assert len(keys) == sum(len(p) for p, _ in packs) and (np.diff(keys) > 0).all()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=300))
def test_patterns_are_the_plain_packing(sizes):
    """Piece by piece and longest first: those of one length go on the packs with the most room, one each, then on the same packs
    again, then on new ones."""
    room = []
    for size in sorted(set(sizes), reverse=True):
        n = sizes.count(size)
        own = sorted((k for k in range(len(room)) if room[k] >= size), key=room.__getitem__, reverse=True)[:n]
        for k in own:
            room[k] -= size
        n -= len(own)
        while n:
            k = max(own, key=room.__getitem__, default=None)
            if k is not None and room[k] >= size:
                room[k] -= size
                n -= 1
            else:
                fit = min(n, 64 // size)
                room.append(64 - fit * size)
                n -= fit
                if n and room[-1] >= size:
                    own.append(len(room) - 1)
    packs = packing.patterns(Counter(sizes), 64)
    assert sum(n for _, n in packs) == len(room)
    left = Counter()
    for pack, n in packs:
        left[64 - sum(pack)] += n
    assert left == Counter(room)


def test_pieces_of_one_length_in_many_shares(spark, monkeypatch):
    """Ranks are gapless over the shares of a length: every sequence is filled from 0 without a gap and no piece is lost."""
    monkeypatch.setattr(packing, "SHARE", 20)
    monkeypatch.setattr(packing, "SHARES", 3)
    docs = [(k, "the cat sat on the mat " * (1 + k % 5)) for k in range(900)] + [(3, "a " * 9000)] * 2
    clash = spark.createDataFrame([(*d, 1, 2, 3) for d in docs], DOC + ", share int, rank int, base int")
    rows = packing.pack_documents(clash, BPE, length=64).collect()
    by = {}
    for x in rows:
        by.setdefault(x.sequence_id, []).append((x.offset, x.length))
    assert sorted(by) == list(range(len(by)))
    for parts in by.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= 64
    packs = packing.patterns(Counter(x.length for x in rows), 64)
    assert len(by) == sum(n for _, n in packs)


@pytest.mark.parametrize("n", [999_999, 1_000_001])
def test_long_texts_are_encoded_alike(n):
    text = ("The quick brown fox's 12 jumps! " * (n // 32 + 1))[:n]
    tokens = _tokens()
    assert tokens(text) == tokens.exact.encode(text, add_special_tokens=False).ids


@given(st.text(st.characters(max_codepoint=0x24F), max_size=200))
@settings(max_examples=200, deadline=None)
def test_fast_encoding_is_the_same(text):
    tokens = packing.Tokens.__new__(packing.Tokens)
    tokens.__dict__ = _tokens().__dict__
    assert tokens(text) == tokens.exact.encode(text, add_special_tokens=False).ids


_held = []


def _tokens():
    if not _held:
        _held.append(packing.Tokens(BPE))
    return _held[0]


# licenses


def test_phrases(spark):
    docs = EDGE + [(1, "CC-BY cc by, all rights reserved"), (2, "General Public\nLicense general public license x"), (3, "all rights éreserved cc_by")]
    for r in licences.scan(frame(spark, docs)).collect():
        w = WORD.findall(lower(dict(docs)[r.doc_id] or ""))
        places, labels = [], set()
        for p, label in licences.PHRASES.items():
            p = p.split()
            at = [k for k in range(len(w)) if w[k : k + len(p)] == p]
            places += at
            labels |= {label} if at else set()
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels)))
        assert set(r.base_labels.split(",")) <= set(r.labels.split(","))
        assert 0 <= r.score <= 1


@pytest.mark.parametrize(
    ("text", "label", "held"),
    [
        ("Released under the MIT License.", "mit", True),
        ("released under the terms of the MIT license", "mit", True),
        ("released under terms of the MIT license", "mit", False),
        ("Licensed under the Apache License, Version 2.0", "apache-2.0", True),
        ("Licensed under the Apache License 1.1", "apache-2.0", False),
        ("This work is licensed under the GNU General Public License, version 3.", "gpl-3.0", True),
        ("Licensed under CC BY-NC 4.0.", "cc-by-nc-4.0", True),
        ("Licensed under CC BY-NC 4.0.", "cc-by-4.0", False),
        ("Copyright (c) 2020 A B. All rights reserved", "all-rights-reserved", True),
    ],
)
def test_templates(text, label, held):
    s = licences.scanner(tuple(sorted(licences.TEMPLATES.items())), tuple(licences.PHRASES.items()))
    ids = np.array([s.ids.get(w, 0) for w in licences.split(text)], np.int64)
    assert (label in s.document(ids)[2]) == held


BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the
documentation and/or other materials provided with the distribution.
%s
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED
TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."""
THIRD = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from
this software without specific prior written permission."""
GNU = """This %s is free software: you can redistribute it and/or modify it under the terms of the GNU %s as published by the Free Software
Foundation, either version %s of the License, or (at your option) any later version."""


@pytest.mark.parametrize(
    ("text", "labels"),
    [
        (BSD % "", {"bsd-2-clause"}),
        (BSD % THIRD, {"bsd-3-clause"}),
        (BSD.replace("binary form must", "binary form may") % THIRD, set()),
        (GNU % ("program", "General Public License", "3"), {"gpl-3.0-or-later"}),
        (GNU % ("program", "General Public License", "2"), {"gpl-2.0-or-later"}),
        (GNU % ("library", "Lesser General Public License", "2.1"), {"lgpl-2.1-or-later"}),
        (GNU % ("program", "Affero General Public License", "3"), {"agpl-3.0-or-later"}),
        ("All rights reserved.", set()),
    ],
)
def test_notices_that_begin_alike(text, labels):
    s = licences.scanner(tuple(sorted(licences.TEMPLATES.items())), tuple(licences.PHRASES.items()))
    ids = np.array([s.ids.get(w, 0) for w in licences.split(text)], np.int64)
    assert s.document(ids)[2] == labels


def as_pattern(template):
    """A template as a regular expression over words that each end in a blank."""
    out = ""
    for part in re.split(r"(<<[^>]*>>)", template):
        if part.startswith("<<var;match"):
            out += "(?:" + "|".join("".join(w + " " for w in x.split()) for x in part[len("<<var;match=") : -2].split("|")) + ")"
        elif m := re.fullmatch(r"<<var;words=(\d+)-(\d+)>>", part):
            out += "(?:[^ ]+ ){%s,%s}" % m.groups()
        else:
            out += {"<<beginOptional>>": "(?:", "<<endOptional>>": ")?"}.get(part) or "".join(w + " " for w in part.split())
    return re.compile("(?:^|(?<= ))" + out)


def written_out(r, template):
    """A random text that the template accepts."""
    out, skip = [], 0
    for part in re.split(r"(<<[^>]*>>)", template):
        if part == "<<beginOptional>>":
            skip += skip > 0 or r.random() < 0.5
        elif part == "<<endOptional>>":
            skip = max(0, skip - 1)
        elif skip:
            continue
        elif part.startswith("<<var;match"):
            out.append(r.choice(part[len("<<var;match=") : -2].split("|")))
        elif m := re.fullmatch(r"<<var;words=(\d+)-(\d+)>>", part):
            out += [r.choice(["acme", "the", "2020"]) for _ in range(r.randrange(int(m[1]), int(m[2]) + 1))]
        else:
            out += part.split()
    return " ".join(out).split()


def test_templates_over_whole_documents(spark):
    r, docs = random.Random(8), list(EDGE)
    for k in range(400):
        w = written_out(r, r.choice(list(licences.TEMPLATES.values())))
        for _ in range(r.choice([0, 0, 0, 1, 2])):
            at = r.randrange(len(w))
            w[at : at + r.randrange(2)] = [r.choice(["x", "license", "the"])] * r.randrange(2)
        around = [r.choice(["the", "under", "software", "mit", "copyright"]) for _ in range(r.randrange(20))]
        docs.append((k, " ".join([*around, *w, *reversed(around)])))
    patterns = {k: as_pattern(t) for k, t in licences.TEMPLATES.items()}
    seen = set()
    for x in licences.scan(frame(spark, docs)).collect():
        text = "".join(w + " " for w in WORD.findall(lower(dict(docs)[x.doc_id] or "")))
        found = {k for k, p in patterns.items() if p.search(text)}
        base = {v for k, v in licences.PHRASES.items() if f" {k} " in " " + text}
        seen |= found
        assert x.labels == ",".join(sorted(found | base)) and x.score == (1.0 if found else 0.5 if base else 0.0)
    assert seen == set(licences.TEMPLATES)


def test_automaton_is_a_regular_expression():
    r = random.Random(4)
    template, pattern = "a <<beginOptional>>b <<beginOptional>>c<<endOptional>><<endOptional>> <<var;match=d|e f>> <<var;words=0-2>> g", r"a( b( c)?)? (d|e f)( [^ ]+){0,2} g"
    ids = {}
    a = licences.Automaton(template, lambda w: ids.setdefault(w, len(ids) + 1))
    for _ in range(3000):
        w = [r.choice("abcdefgh") for _ in range(r.randrange(1, 9))]
        assert (a.accepts([ids.get(x, 0) for x in w], 0) is not None) == bool(re.match(pattern + r"( |$)", " ".join(w)))


# decontamination


def hits(text, items, size=10):
    w = WORD.findall(lower(text or ""))
    hit, found = set(), set()
    for i, t in items:
        x = WORD.findall(lower(t or ""))
        n = min(size, len(x))
        windows = {tuple(x[k : k + n]) for k in range(len(x) - n + 1)} if n else set()
        for k in range(len(w) - n + 1) if n else ():
            if tuple(w[k : k + n]) in windows and i is not None:
                hit |= set(range(k, k + n))
                found.add(str(i))
    return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


@pytest.mark.parametrize(("block_bytes", "group"), [(1 << 20, 16), (400, 16), (60, 2)])
def test_windows(spark, monkeypatch, block_bytes, group):
    monkeypatch.setattr(decontamination, "GROUP", group)
    r = random.Random(7)
    word = lambda: r.choice(["a", "b", "É", "the", "of", "x1", "Q"])
    items = [(k, " ".join(word() for _ in range(n))) for k, n in enumerate([0, 1, 2, 3, 9, 10, 11, 25, 40])] + [(10, None), (11, "a-b.c The"), (12, "a-b.c The")]
    docs = list(EDGE)
    for k in range(60):
        parts = [" ".join(word() for _ in range(r.randrange(12)))]
        if r.random() < 0.6:
            x = r.choice(items)[1] or ""
            parts.append(x if r.random() < 0.5 else x[r.randrange(9) :])
        docs.append((k, "\n".join(parts)))
    got = decontamination.decontaminate(frame(spark, docs), spark.createDataFrame(items, "item_id long, text string"), block_bytes=block_bytes).collect()
    assert {r.doc_id: tuple(r)[1:] for r in got} == {d: hits(t, items) for d, t in docs}
    assert len(got) == len(docs)
    kept = decontamination.keep_clean(frame(spark, docs), spark.createDataFrame(items, "item_id long, text string"), block_bytes=block_bytes).collect()
    assert Counter((x.doc_id, x.text) for x in kept) == Counter((d, t) for d, t in docs if not hits(t, items)[4])
    assert decontamination.decontaminate(frame(spark, []), spark.createDataFrame(items, "item_id long, text string"), block_bytes=block_bytes).collect() == []
    none = spark.createDataFrame([], "item_id long, text string")
    assert {r.n_hit for r in decontamination.decontaminate(frame(spark, docs), none).collect()} == {0}


def thue_morse(n):
    t = "a"
    while len(t) < n:
        t += t.translate(str.maketrans("ab", "ba"))
    return t, t.translate(str.maketrans("ab", "ba"))


@pytest.mark.parametrize("n", [1024, 4096])
def test_words_that_collide_modulo_powers_of_two(spark, n):
    one, other = thue_morse(n)
    items = spark.createDataFrame([(1, one)], "item_id long, text string")
    got = decontamination.decontaminate(frame(spark, [(1, one), (2, other)]), items).collect()
    assert {r.doc_id: r.contaminated for r in got} == {1: True, 2: False}
    assert [r.labels for r in licences.scan(frame(spark, [(1, other)]), {"t": one}, {one: "p"}).collect()] == [""]
    hashed = _text.RangeHash(np.frombuffer((one + other).encode(), np.uint8))
    assert len(set(hashed(np.array([0, n]), np.array([n, 2 * n])).tolist())) == 2


def test_bytes_decide_where_hashes_collide(spark, monkeypatch):
    class Same(_text.RangeHash):
        def __call__(self, start, end):
            return np.full(len(start), 7, np.uint64)

    monkeypatch.setattr(decontamination, "RangeHash", Same)
    index = decontamination.Index([("1", "ab cd"), ("2", "x")])
    texts = pa.array(["ab cd", "ab ce", "q x q", "abc"])
    got = [(i, sorted(items)) for i, _, _, items in decontamination._scan([index], pa.RecordBatch.from_arrays([texts], names=["text"]), 0)]
    assert got == [(0, ["1"]), (1, []), (2, ["2"]), (3, [])]


# secrets


def base_spans(t):
    found = [(*m.span(), "assign") for m in secrets.ASSIGN.finditer(t) if len(m[2]) >= 6]
    found += [(*m.span(), "access") for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    return found + [(*m.span(), "hex") for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]


def test_base_spans(spark):
    r = random.Random(3)
    bits = ['PassWord="', "secret", "token", ":", " = ", "'", "api_key:", "APIKEY=", "abc", "key12345", "AKIA", "ABCDEFGHIJKLMNOP1", "0123456789abcdef", "é😀", " ", "\n", "ſecret=abcdefgh", "toKen: xyzabc1"]
    docs = EDGE + [(k, "".join(r.choice(bits) for _ in range(r.randrange(14)))) for k in range(300)]
    order = {k: n for n, k in enumerate(secrets.KINDS)}
    for x in secrets.scan(frame(spark, docs)).collect():
        want = sorted(base_spans(dict(docs)[x.doc_id] or ""), key=lambda s: (s[0], order[s[2]]))
        text = ",".join(f"{k}:{a}:{b}" for a, b, k in want)
        assert [x.n_assign, x.n_access, x.n_hex] == [sum(k == kind for _, _, k in want) for kind in secrets.KINDS]
        assert x.base_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert set(filter(None, text.split(","))) <= set(x.spans.split(","))


def seq(*parts):
    body = b"".join(parts)
    return b"\x30" + (bytes([len(body)]) if len(body) < 128 else b"\x82" + len(body).to_bytes(2, "big") if len(body) > 255 else b"\x81" + bytes([len(body)])) + body


def integer(n):
    return b"\x02" + (bytes([n]) if n < 128 else b"\x81" + bytes([n]) if n < 256 else b"\x82" + n.to_bytes(2, "big")) + b"\x11" * n


def field(x):
    return len(x).to_bytes(4, "big") + x


VERSION = b"\x02\x01\x00", b"\x02\x01\x01"
OCTETS = b"\x04\x20" + b"k" * 32
ED25519 = seq(b"\x06\x03\x2b\x65\x70")
PUBLIC = field(b"ssh-ed25519") + field(bytes(range(32)))
OPENSSH = b"openssh-key-v1\0" + field(b"none") * 2 + field(b"") + (1).to_bytes(4, "big") + field(PUBLIC) + field(b"x" * 40)
PRIVATE = {
    "pkcs1": seq(VERSION[0], *(integer(n) for n in (129, 3, 129, 64, 64, 64, 64, 64))),
    "dsa": seq(VERSION[0], *(integer(n) for n in (128, 20, 128, 128, 20))),
    "pkcs8": seq(VERSION[0], ED25519, b"\x04\x22" + OCTETS),
    "sec1": seq(VERSION[1], OCTETS, b"\xa0\x0a\x06\x08\x2a\x86\x48\xce\x3d\x03\x01\x07"),
    "encrypted": seq(seq(b"\x06\x09" + bytes.fromhex("2a864886f70d01050d"), seq(OCTETS)), b"\x04\x40" + b"e" * 64),
}
OTHER = {
    "public": seq(seq(b"\x06\x09" + bytes.fromhex("2a864886f70d010101"), b"\x05\x00"), b"\x03\x82\x01\x0f\x00" + seq(integer(257), integer(3)).ljust(270, b"x")[:270]),
    "rsa_public": seq(integer(129), integer(3)),
    "certificate": seq(seq(b"\xa0\x03\x02\x01\x02", integer(8), ED25519), ED25519, b"\x03\x41\x00" + b"s" * 64),
    "integer_and_bytes": seq(VERSION[1], b"\x04\x13" + b"n" * 19),
    "four_integers": seq(*(integer(n) for n in (1, 60, 100, 30))),
    "trailing": PRIVATE["pkcs1"] + b"\x00",
    "nested_length": seq(VERSION[0], ED25519[:-1], b"\x04\x22" + OCTETS),
    "ssh_public": PUBLIC,
    "openssh_short": OPENSSH[:-1],
}
EVERY = set(secrets.MAY)


def kinds(text):
    return {k for _, _, k in secrets.structures(text, EVERY)}


def armour(data, kind="RSA PRIVATE KEY", headers=""):
    text = base64.b64encode(data).decode()
    return f"-----BEGIN {kind}-----\n{headers}" + "\n".join(text[k : k + 64] for k in range(0, len(text), 64)) + f"\n-----END {kind}-----"


@pytest.mark.parametrize("name", PRIVATE)
def test_private_keys(name):
    data = PRIVATE[name]
    assert secrets.private_key(data) and not secrets.private_key(data[:-1]) and not secrets.private_key(b"\x31" + data[1:])
    assert kinds(f"x {base64.b64encode(data).decode()} y") == {"base64_der"}
    assert kinds(f"h {data.hex()}0 h") == {"hex_der"} and "pem_der" in kinds(armour(data))


@pytest.mark.parametrize("name", OTHER)
def test_public_keys_and_other_structures_are_no_secrets(name):
    data = OTHER[name]
    text = f"x {base64.b64encode(data).decode()} y K={base64.b64encode(data).decode()} " + armour(data)
    assert not kinds(text) and secrets.redact(pa.array([text])) == [text]
    assert not kinds(f"h {OTHER['four_integers'].hex()} h")


def test_encrypted_armour():
    headers = "Proc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,0123456789ABCDEF0123456789ABCDEF\n\n"
    assert kinds(armour(b"c" * 640, headers=headers)) == {"pem_encrypted"}
    assert not kinds(armour(b"c" * 641, headers=headers)) and not kinds(armour(b"c" * 640)) and not kinds(armour(b"c" * 640, headers="Comment: x\n\n"))
    assert kinds(armour(OPENSSH, "OPENSSH PRIVATE KEY")) >= {"pem_openssh"}


def pgp(packet, checksum=True):
    crc = 0xB704CE
    for byte in packet:
        crc ^= byte << 16
        for _ in range(8):
            crc = crc << 1 ^ (0x1864CFB if crc & 0x800000 else 0)
    body = base64.b64encode(packet).decode()
    lines = "\n".join(body[k : k + 64] for k in range(0, len(body), 64))
    tail = "\n=" + base64.b64encode(crc.to_bytes(3, "big")).decode() if checksum else ""
    return f"-----BEGIN PGP PRIVATE KEY BLOCK-----\nVersion: X 1.0\n\n{lines}{tail}\n-----END PGP PRIVATE KEY BLOCK-----"


@pytest.mark.parametrize("name", PRIVATE)
def test_forms_of_armour(name):
    """Escaped as in JSON, quoted, commented out, concatenated, indented and in the other alphabet."""
    data = PRIVATE[name]
    plain = armour(data)
    forms = {
        "json": plain.replace("\n", "\\n"), "windows json": plain.replace("\n", "\\r\\n"), "mail": "\n".join("> " + x for x in plain.split("\n")),
        "twice quoted": "\n".join(">> " + x for x in plain.split("\n")), "comment": "\n".join("# " + x for x in plain.split("\n")), "block comment": "\n".join(" * " + x for x in plain.split("\n")),
        "source": "\n".join(f'"{x}\\n" +' for x in plain.split("\n")), "env": 'KEY="' + plain.replace("\n", "\\n") + '"', "crlf": plain.replace("\n", "\r\n"), "indented": plain.replace("\n", "\n    "),
    }
    for form, text in forms.items():
        assert "pem_der" in kinds(f"x {text} y"), form
        assert "-----BEGIN" not in secrets.redact(pa.array([f"x {text} y"]))[0], form
    url = base64.urlsafe_b64encode(data).decode().rstrip("=")
    assert kinds(f"x {url} y") == {"base64_der"}
    for other in OTHER.values():
        text = armour(other).replace("\n", "\\n") + " " + base64.urlsafe_b64encode(other).decode()
        assert not kinds(text)


def test_openpgp_blocks():
    key = bytes([4]) + b"\0\0\0\1" + bytes([22]) + bytes(range(60))
    old, new, long = b"\x95" + len(key).to_bytes(2, "big") + key, b"\xc5" + bytes([len(key)]) + key, b"\xc5\xff" + len(key).to_bytes(4, "big") + key
    user = b"\xcd\x03abc"
    for packet in (old, new, long, new + user):
        assert kinds(pgp(packet)) == {"pgp_private"} and kinds(pgp(packet, False)) == {"pgp_private"}
        assert kinds(pgp(packet).replace("\n", "\\n")) == {"pgp_private"}
    public = b"\xc6" + bytes([len(key)]) + key
    for packet in (public, new[:-1], user + new, b"\xc5\x03\x04ab", bytes(80)):
        assert not kinds(pgp(packet))
    assert not kinds(pgp(new).replace("\n=", "\n=A", 1))


def test_long_runs_stay_linear():
    for text in ("-----BEGIN " + "A" * 200_000, "-----BEGIN PRIVATE KEY-----" + "\\n> a: b" * 50_000, "-----BEGIN PRIVATE KEY-----" * 3_000, "ey" + "A" * 300_000 + ".", "M" + "A-" * 200_000):
        assert not kinds(text)


def test_signed_tokens():
    for header in ('{ "alg": "HS256" }', '{\n  "alg": "none"}', '{\t"typ":"JWT","alg":"RS256"}', '{\r\n"alg":"x"}'):
        token = base64.urlsafe_b64encode(header.encode()).decode().rstrip("=") + ".e30.c2ln"
        assert kinds(f"x {token} y") == {"signed_token"}
    part = lambda o: base64.urlsafe_b64encode(json.dumps(o).encode()).decode().rstrip("=")
    token = f"{part({'alg': 'HS256', 'typ': 'JWT'})}.{part({'sub': 1})}.c2ln"
    assert kinds(f"x {token} y") == {"signed_token"}
    assert not kinds(f"x {part({'typ': 'JWT'})}.e30.c2ln y") and not kinds("MIIB" + "A" * 60)
    assert secrets.redact(pa.array([f"a {token} b password=abcdef1 c", None])) == ["a [SECRET] b [SECRET] c", None]


def test_long_texts_and_empty_table(spark):
    key = base64.b64encode(PRIVATE["pkcs8"]).decode()
    text = "word " * 400_000 + key + " é" * 100_000 + " secret=abcdefg"
    got = secrets.scan(frame(spark, [(1, text)])).first()
    assert got.spans == f"base64_der:2000000:{2000000 + len(key)},assign:{len(text) - 14}:{len(text)}" and got.n_assign == 1
    assert secrets.scan(frame(spark, [])).collect() == []
    assert len(list(secrets.structures("MII" + "A" * 3_000_000 + " 30" + "8" * 3_000_000, EVERY))) == 0


# quality


def counts(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
    at = {}
    for k in range(len(w) - 2):
        at.setdefault(tuple(w[k : k + 3]), []).append(k)
    again = {k + j for v in at.values() if len(v) > 1 for k in v for j in range(3)}
    lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n = len(w)
    return n, sum(map(len, w)), sum((t or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(again), n < 50 or 100 * len(again) > 50 * n


def test_counts(spark):
    r = random.Random(5)
    docs = EDGE + [(k, "".join(r.choice(["a", "b", "ab", " ", " ", "\n", "\x0b", "#", "é|", "😀"]) for _ in range(r.choice([5, 50, 400])))) for k in range(150)]
    labels = spark.createDataFrame([(k, int(k % 2), 0) for k in range(100)] + [(None, 1, 0), (3, 1, 0)], "doc_id long, quality int, toxic int")
    rows = quality.quality(frame(spark, docs), labels).collect()
    assert len(rows) == len(docs)
    for x in rows:
        assert tuple(x)[1:7] == counts(dict(docs)[x.doc_id]), x
        assert not (x.base_failed and x.kept)
    kept = quality.keep(frame(spark, docs), labels)
    assert kept.columns == ["doc_id", "text"] and {x.doc_id for x in kept.collect()} == {x.doc_id for x in rows if x.kept}
    assert quality.quality(frame(spark, []), labels).collect() == []


def test_ratio_is_the_one_of_the_counts(spark):
    docs = [(k, "clean words here now " * 15) for k in range(20)] + [(k, "junk%% stuff## " * 3 + " ".join(f"z{k}{j}%%" for j in range(60))) for k in range(20, 40)]
    labels = spark.createDataFrame([(k, int(k < 20), 0) for k in range(40)], "doc_id long, quality int, toxic int")
    rows = quality.quality(frame(spark, docs), labels).collect()
    assert {x.doc_id for x in rows if x.llr > 0} == set(range(20))
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {x.llr for x in quality.quality(frame(spark, docs), none).collect()} == {0.0}


def plain_ratios(docs, good, buckets):
    """Each text's words, base failure and mean ratio, n-gram by n-gram."""
    long = lambda x, seed: xxhash.xxh64((x & (1 << 64) - 1).to_bytes(8, "little"), seed=seed).intdigest()

    def grams(t):
        one = [xxhash.xxh64(w.encode(), seed=42).intdigest() for w in re.findall(r"[^\x20\x09-\x0D]+", t or "")]
        signed = [h - (1 << 64) if h >> 63 else h for h in one + [long(b, long(a, 42)) for a, b in zip(one, one[1:])]]
        return [h % buckets for h in signed]

    raw, target = Counter(), Counter()
    for i, t in docs:
        raw.update(grams(t))
        target.update(grams(t) if i in good else [])
    n, m = sum(raw.values()), sum(target.values())
    weight = {b: math.log((target[b] + 50 * m / n) / ((r - 1 + 50) * m / n)) for b, r in raw.items()} if m else Counter()
    return {i: sum(weight[b] for b in g) / len(g) if (g := grams(t)) else None for i, t in docs}


@pytest.mark.parametrize("buckets", [256, 1 << 18])
def test_ratios_and_verdicts(spark, buckets):
    r = random.Random(buckets)
    words = [f"w{k}é" for k in range(400)]
    docs = [(k, " ".join(r.choice(words) for _ in range(r.choice([10, 60, 90, 300])))) for k in range(120)]
    docs += [(k, " | ".join(r.choice(words) for _ in range(60))) for k in range(120, 160)] + [(200, None), (201, " "), (202, "one"), (203, "w1é " * 90)]
    labelled = [(k, int(k < 120), int(k % 11 == 0)) for k in range(160) if k % 3]
    good = {k for k, q, t in labelled if q and not t}
    clash = [(*d, 1, 2, 3, 4, 5) for d in docs]
    frame = spark.createDataFrame(clash, DOC + ", h1 int, h2 int, words int, kept int, trusted int")
    labels = spark.createDataFrame(labelled, "doc_id long, quality int, toxic int")
    want = plain_ratios(docs, good, buckets)
    rows = quality.quality(frame, labels, buckets).collect()
    assert len(rows) == len(docs)
    for x in rows:
        failed = counts(dict(docs)[x.doc_id])[5]
        assert (x.llr is None) == (want[x.doc_id] is None) and (x.llr is None or abs(x.llr - want[x.doc_id]) < 2e-6)
        assert x.base_failed == failed and x.kept == (not failed and want[x.doc_id] >= quality.THRESHOLD)
    kept = {x.doc_id for x in rows if x.kept}
    assert kept and not kept & set(range(120, 160))
    out = quality.keep(frame, labels, buckets)
    assert out.columns == frame.columns and {tuple(x) for x in out.collect()} == {x for x in clash if x[0] in kept}


def test_verdicts_hold_at_every_size(spark):
    """Junk of one kind goes and clean documents stay, whether the corpus has hundreds of documents or thousands."""
    for n in (200, 4000):
        r = random.Random(n)
        text = lambda: " ".join("".join(r.choice(["an", "er", "th", "on", "st", "le"]) for _ in range(r.randrange(1, 4))) for _ in range(80))
        docs = [(k, text() if k % 7 else " | ".join(text().split()[:55])) for k in range(n)]
        labels = spark.createDataFrame([(k, int(k % 7 > 0), 0) for k in range(0, n, 2)], "doc_id long, quality int, toxic int")
        kept = {x.doc_id for x in quality.quality(frame(spark, docs), labels).collect() if x.kept}
        assert kept == {k for k in range(n) if k % 7}


def test_keys_straight_after_an_equals_sign():
    """The env-file form of a base64 key, of each kind, is found and redacted; so is one after another's padding."""
    for data, kind in ((PRIVATE["pkcs8"], "base64_der"), (OPENSSH, "base64_openssh")):
        key = base64.b64encode(data).decode()
        for before in ("PRIVATE_KEY=", "export K=", "A=QUJDRA=="):
            text = f"{before}{key}\nX=1"
            assert (len(before), len(before) + len(key), kind) in secrets.structures(text, set(secrets.MAY))
            assert key not in secrets.redact(__import__("pyarrow").array([text]))[0]
    assert list(secrets.structures("K=" + "M" * 60 + " K=" + "AAA" * 20, set(secrets.MAY))) == []


def test_clashing_columns_and_empty_tables(spark):
    """Scans read doc_id and text alone, whatever else a table holds, and an empty table gives no rows."""
    names = ("n_words", "spans", "items", "labels", "score", "row", "part", "of", "item", "n_hit", "contaminated")
    docs = [(1, "All rights reserved one two three token=abcdef12"), (1, "All rights reserved one two three token=abcdef12"), (2, None)]
    table = spark.createDataFrame([(*d, *range(len(names))) for d in docs], DOC + "".join(f", {n} int" for n in names))
    items = spark.createDataFrame([(1, "one two three", 5, 6)], "item_id long, text string, part int, of int")
    for rows in (licences.scan(table), secrets.scan(table), decontamination.decontaminate(table, items), decontamination.decontaminate(table, items, block_bytes=1)):
        plain = [tuple(x) for x in rows.collect()]
        assert sorted(x[0] for x in plain) == [1, 1, 2] and len(set(plain)) == 2
    assert {x.doc_id: x.n_hit for x in decontamination.decontaminate(table, items).collect()} == {1: 3, 2: 0}
    assert licences.scan(frame(spark, [])).collect() == [] and secrets.scan(frame(spark, [])).collect() == []
