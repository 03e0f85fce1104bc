import gzip
import hashlib
import random
import textwrap

import pyarrow.parquet as pq
import pytest
from helpers import docs, empty, odd
from pyspark.sql import functions as F

from bytelode.llm import license_texts, licenses, linededup, warc
from conftest import DATA


def brute(rows, least=10):
    keys, held = {}, {}
    for i, text in rows:
        for pos, line in enumerate((text or "").split("\n")):
            k = linededup.line_key(line)
            keys[i, pos] = k
            held.setdefault(k, set()).add(i)
    out = {}
    for i, text in rows:
        lines = (text or "").split("\n")
        stay = [x for pos, x in enumerate(lines) if not (len(k := keys[i, pos]) >= least and len(held[k]) > 1 and min(held[k]) != i)]
        out[i] = (len(lines), len(lines) - len(stay), hashlib.sha256("\n".join(stay).encode()).hexdigest())
    return out


@pytest.mark.parametrize("parts", ["1", "4", "23"])
def test_lines(spark, parts):
    rng = random.Random(11)
    pool = [f"line number {k} of them" for k in range(12)] + ["short", "", "  PADDED LINE of text\t", "padded line of text", "é" * 9, "é" * 10]
    rows = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randint(0, 12))) or None) for i in range(120)]
    rows += [(500 + i, "the same line everywhere\r\n" * 3) for i in range(80)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    got = {r.doc_id: (r.n_lines, r.n_dropped, r.kept_sha256) for r in linededup.digest(docs(spark, rows)).collect()}
    texts = {r.doc_id: r.text for r in linededup.dedup_texts(docs(spark, rows)).collect()}
    spark.conf.set("spark.sql.shuffle.partitions", before)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    expected = brute(rows)
    assert got == expected
    assert {i: hashlib.sha256((t or "").encode()).hexdigest() for i, t in texts.items()} == {i: e[2] for i, e in expected.items()}


def test_lines_odd(spark):
    rows = linededup.digest(odd(spark)).collect()
    assert len(rows) == 8 and {r.n_lines for r in rows if r.doc_id in (2, 3)} == {1} and not any(r.n_dropped for r in rows)
    kept = linededup.dedup_texts(odd(spark))
    assert kept.columns == odd(spark).columns and kept.count() == 8 and kept.filter("doc_id = 3").first().text is None
    assert linededup.digest(empty(spark)).collect() == []
    late = docs(spark, [(None, "a line that others have"), (3, "a line that others have"), (3, "a line that others have")])
    assert sorted((r.doc_id or -1, r.n_dropped) for r in linededup.digest(late).collect()) == [(-1, 1), (3, 0), (3, 0)]


def test_bitmaps():
    import zlib

    import numpy as np

    keep = zlib.compress(np.packbits(np.array([1, 0, 1, 1, 1, 1, 1, 1, 0, 1, 1, 1, 1, 1, 1, 1], np.uint8)).tobytes())
    assert linededup.unpack(keep, 20).tolist() == [i not in (1, 8) for i in range(20)]
    assert linededup.unpack(None, 3).tolist() == [True] * 3


@pytest.mark.parametrize(
    "text, found",
    [
        ("Some text.\nReleased under the MIT License.\nMore.", ["MIT"]),
        ("Licensed under CC BY-NC 4.0.", ["CC-BY-NC-4.0"]),
        ("Licensed under CC BY-SA 4.0.", ["CC-BY-SA-4.0"]),
        ("This work is licensed under the GNU General Public License, version 3.", ["GPL-3.0"]),
        ("This work is licensed under the GNU General Public License, version 2.", ["GPL-2.0"]),
        ("This work is licensed under the GNU Lesser General Public License, version 3.", ["LGPL-3.0"]),
        ("LICENSED UNDER THE APACHE LICENSE, VERSION 2.0.", ["Apache-2.0"]),
        ("Licensed under the Apache License, Version 1.1.", []),
        ("A license to dance is required by the city.", []),
        ("Released under the MIT License.\nLicensed under the Apache License, Version 2.0.", ["Apache-2.0", "MIT"]),
        ("# SPDX-License-Identifier: GPL-3.0", ["GPL-3.0"]),
        (dict(license_texts.FULL)["MIT"].replace(", to ", ",\nto "), ["MIT"]),
        (None, []), ("", []),
    ],
)
def test_licenses(text, found):
    assert sorted({r[2] for r in licenses.scan_text(text)}) == found


def test_license_frame(spark):
    line = "Licensed under CC BY 4.0."
    d = docs(spark, [(1, f"x\n{line}\ny"), (2, None), (3, "nothing"), (4, "word " * 20_000 + "\n" + line)])
    rows = licenses.scan(d).collect()
    assert {(r.doc_id, r.license, r.differences) for r in rows} == {(1, "CC-BY-4.0", 0), (4, "CC-BY-4.0", 0)}
    assert all(0 < r.reduction < 1 for r in rows) and {(r.start, r.stop) for r in rows if r.doc_id == 1} == {(2, 27)}
    assert licenses.scan(empty(spark)).collect() == [] and licenses.scan(odd(spark)).collect() == []


PAGES = "page_id long, url string, html string"


def test_round_trip(spark):
    rows = [(1, "http://a/", "<p>x</p>"), (2, "http://b/", "<p>x</p>"), (3, None, None), (4, "http://c/\r\nd", ""), (5, "u", "été " * 3), (None, "u", "<p>x</p>"), (7, "u", "only"), (7, "u", "only"), (8, "u", "a" * 300_000)]
    got = {(r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in warc.round_trip(spark.createDataFrame(rows, PAGES)).collect()}
    assert got == {(1, 8, "revisit", 2), (2, 8, "response", None), (None, 8, "revisit", 2), (3, 0, "revisit", 4), (4, 0, "response", None), (5, 24, "response", None), (7, 4, "response", None), (8, 300_000, "response", None)}
    digests = {r.page_id: r.payload_digest for r in warc.round_trip(spark.createDataFrame(rows, PAGES)).collect()}
    assert digests[5] == warc.sha1(("été " * 3).encode())
    assert warc.round_trip(spark.createDataFrame([], PAGES)).collect() == []
    small = {(r.page_id, r.record_type) for r in warc.round_trip(spark.createDataFrame(rows, PAGES), least=9).collect()}
    assert (1, "response") in small and (3, "response") in small


@pytest.mark.parametrize("compress", [True, False])
def test_salvage(spark, compress):
    pages = spark.createDataFrame([(i, f"http://x/{i}", f"<p>{i}</p>" * 20) for i in range(20)], PAGES).coalesce(1)
    (row,) = warc.write_archives(pages, compress=compress).collect()
    whole = list(warc.salvage("a", bytes(row.content)))
    assert [r[3] for r in whole] == ["record"] * 21
    bad = bytearray(row.content)
    start, stop = whole[5][1], whole[5][2]
    bad[start + 30 : start + 60] = b"\xff" * 30
    got = list(warc.salvage("a", bytes(bad)))
    gaps = [r for r in got if r[3] == "gap"]
    assert [(r[1], r[2]) for r in gaps] == [(start, stop)] and sum(r[3] == "record" for r in got) == 20
    cut = list(warc.salvage("a", bytes(row.content)[: whole[-1][1] + 40]))
    assert cut[-1][3] == "gap" and sum(r[3] == "record" for r in cut) == 20
    noise = b"junk" * 5 + bytes(row.content)
    assert [r[3] for r in warc.salvage("a", noise)] == ["gap"] + ["record"] * 21
    assert list(warc.salvage("a", b"")) == [] and [r[3] for r in warc.salvage("a", b"\x1f\x8b\x08WARC/1.0\r\n")] == ["gap"]


def test_random_damage_never_raises():
    rng = random.Random(5)
    data = b"".join(warc.member(warc.record(i, "u", "text " * 30, None, False)) for i in range(10))
    for _ in range(60):
        bad = bytearray(data)
        for _ in range(rng.randint(1, 4)):
            at = rng.randrange(len(bad))
            if rng.random() < 0.5:
                bad[at] ^= rng.randint(1, 255)
            else:
                del bad[at : at + rng.randint(1, 40)]
        rows = list(warc.salvage("a", bytes(bad)))
        places = [(r[1], r[2]) for r in rows]
        assert places[0][0] == 0 and places[-1][1] == len(bad) and all(a[1] == b[0] for a, b in zip(places, places[1:]))
        assert sum(r[3] == "record" for r in rows) >= 5


def test_files(spark, tmp_path):
    (tmp_path / "a.warc.gz").write_bytes(warc.member(warc.record(1, "u", "x", None, False)))
    (tmp_path / "b.warc").write_bytes(warc.record(2, "u", "y", None, False))
    rows = warc.read_archives(warc.archive_files(spark, str(tmp_path))).select("page_id", F.col("payload")).collect()
    assert {(r.page_id, bytes(r.payload)) for r in rows} == {(1, b"x"), (2, b"y")}
    assert gzip.decompress((tmp_path / "a.warc.gz").read_bytes()).startswith(b"WARC/1.1\r\n")


def test_licenses_in_long_lines():
    """Each template, unchanged, in lines of some 6,000 characters of prose."""
    rows = pq.read_table(f"{DATA.replace('0.001', '0.01')}/documents.parquet", columns=["text", "lang"]).to_pylist()
    prose = " ".join(r["text"] for r in rows if r["lang"] == "en" and r["text"] and not licenses.HINT.search(r["text"])).split()
    rng = random.Random(1)
    for name, template in licenses.TEMPLATES:
        for _ in range(4):
            at = rng.randrange(len(prose) - 1000)
            words = prose[at : at + 1000]
            words.insert(rng.randrange(1000), template)
            assert (name, 0) in {(r[2], r[4]) for r in licenses.scan_text(" ".join(words))}


def test_several_licenses_in_a_line():
    mit, apache = "Released under the MIT License.", "Licensed under the Apache License, Version 2.0."
    assert [r[:3] for r in licenses.scan_text(f"{mit} {apache}")] == [(0, 31, "MIT"), (32, 79, "Apache-2.0")]
    long = f"{mit} {'word ' * 5000}{apache} {'word ' * 3000}{mit}"
    assert [(r[2], long[r[0] : r[1]]) for r in licenses.scan_text(long)] == [("MIT", mit), ("Apache-2.0", apache), ("MIT", mit)]
    assert all(len(licenses.scan_text(template)) == 1 for _, template in licenses.TEMPLATES)


@pytest.mark.parametrize("prefix", ["", "# ", " * "])
def test_wrapped_licenses(prefix):
    """Full texts at their usual widths, in which many lines have no word of a license."""
    for width in (30, 60, 78):
        for name, template in licenses.TEMPLATES:
            text = "\n".join(prefix + line for line in ["Heading", "", *textwrap.wrap(template, width, break_on_hyphens=False, break_long_words=False), "", "more", "words"])
            assert [(r[2], r[4]) for r in licenses.scan_text(text)] == [(name, 0)], text


def foreign(kind, block, *lines):
    head = ["WARC/1.0", "WARC-Type: response", "WARC-Record-ID: <urn:uuid:1>", f"Content-Type: {kind}", f"Content-Length: {len(block)}", *lines]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def test_foreign_archives():
    """Digests are optional and may be of other kinds, blocks need not be HTTP, and a member may hold many records."""
    http, dns = b"HTTP/1.1 200 OK\r\n\r\nbody", b"20240101000000\nexample.org. 300 IN A 192.0.2.1\n"
    hexed = hashlib.sha1(b"body").hexdigest()
    sound = [
        foreign("application/http;msgtype=response", http), foreign("application/http", http, "WARC-Payload-Digest: md5:0123"), foreign("application/http", http, f"WARC-Payload-Digest: sha1:{hexed}", f"WARC-Block-Digest: SHA1:{hashlib.sha1(http).hexdigest().upper()}"),
        foreign("text/dns", dns, f"WARC-Payload-Digest: sha1:{warc.sha1(dns)}"), foreign("text/plain", b"a\r\n\r\nb", f"WARC-Payload-Digest: sha1:{warc.sha1(b'a' + b'\r\n\r\n' + b'b')}"),
    ]
    payloads = [b"body"] * 3 + [dns, b"a\r\n\r\nb"]
    at = warc.NAMES.index("payload")
    bad = foreign("application/http", http, f"WARC-Payload-Digest: sha1:{warc.sha1(b'other')}")
    for data in (b"".join(sound), b"".join(map(warc.member, sound)), warc.member(b"".join(sound))):
        rows = list(warc.salvage("a", data))
        assert [(r[3], r[at]) for r in rows] == [("record", p) for p in payloads] and rows[-1][2] == len(data)
    mixed = warc.member(b"".join([sound[0], bad, *sound[1:]]))
    assert [(r[3], r[4], r[1], r[2]) for r in warc.salvage("a", mixed)] == [("record", None, 0, len(mixed)), ("gap", "payload digest", 0, len(mixed))] + [("record", None, 0, len(mixed))] * 4
    assert [r[3] for r in warc.salvage("a", warc.member(bad) + warc.member(sound[0]) + warc.member(b""))] == ["gap", "record", "gap"]


def difference(template: list[str], found: list[str]) -> int:
    """Words left out and added, by the longest common subsequence, step by step."""
    row = [0] * (len(found) + 1)
    for t in template:
        before = row[:]
        for j, w in enumerate(found):
            row[j + 1] = before[j] + 1 if t == w else max(row[j], before[j + 1])
    return len(template) + len(found) - 2 * row[-1]


def test_licenses_against_brute_force():
    """Every template with every run of words, without the search for likely stretches and without tables."""
    rng = random.Random(3)
    names = sorted({w for _, t in license_texts.SHORT for w in licenses.words(t)})
    for _ in range(6):
        text: list[str] = []
        for _ in range(2):
            template = licenses.words(rng.choice(license_texts.SHORT)[1])
            for _ in range(rng.randint(0, 3)):
                at = rng.randrange(len(template))
                template[at : at + rng.randint(0, 1)] = [rng.choice([*names, "word"])][: rng.randint(0, 1)]
            text += [rng.choice(["the", "word", "under", "license"]) for _ in range(rng.randint(0, 5))] + template
        got = {(i, d, stop) for i, d, _, stop in licenses.confirmed(text, 0.25) if i < len(license_texts.SHORT)}
        expected = set()
        for i, (_, raw) in enumerate(license_texts.SHORT):
            template = licenses.words(raw)
            most = int(0.25 * len(template))
            tell = [w for w in template if licenses.telling(w, False)]
            for stop in range(1, len(text) + 1):
                runs = [text[start:stop] for start in range(max(0, stop - len(template) - most), stop)]
                # Between telling words, which are never left out, words are compared apart.
                best = [sum(map(difference, pieces(template), pieces(run))) for run in runs if [w for w in run if licenses.telling(w, False)] == tell]
                if best and min(best) <= most:
                    expected.add((i, min(best), stop))
        assert got == expected


def pieces(found):
    out = [[]]
    for w in found:
        out[-1].append(w)
        if licenses.telling(w, False):
            out.append([])
    return out


FULL = {"MIT": 1, "BSD-2-Clause": 3, "BSD-3-Clause": 4, "ISC": 7, "0BSD": 8, "Zlib": 9}


@pytest.mark.parametrize("width", [60, 72, 80])
@pytest.mark.parametrize("name", sorted(FULL))
def test_published_texts(name, width):
    """With a heading, a copyright line and numbers of items, as they are published."""
    template = license_texts.FULL[FULL[name]]
    assert template[0] == name
    text = template[1].replace("Redistributions of", "1. Redistributions of").replace("Redistributions in", "2. Redistributions in").replace("Neither", "3. Neither").replace("copyright holder nor", "Example Institute nor")
    text = "Copyright (c) 2019, 2021 A. Person\n\n" + "\n".join(textwrap.wrap(text, width))
    assert [r[2] for r in licenses.scan_text(f"some words\n\n{text}\n\nmore words")] == [name]


@pytest.mark.parametrize("name, template", license_texts.NOTICES)
def test_notices(name, template):
    for width in (60, 72, 80):
        text = "\n".join(f"# {line}" for line in textwrap.wrap(template, width, break_on_hyphens=False, break_long_words=False))
        assert [r[2] for r in licenses.scan_text(f"{text}\n\nimport os")] == [name]


@pytest.mark.parametrize("line, name", [("// SPDX-License-Identifier: MPL-2.0", "MPL-2.0"), ("SPDX-License-Identifier: BSD-3-Clause */", "BSD-3-Clause"), ("# SPDX-License-Identifier: GPL-2.0-only", "GPL-2.0-only"), ("SPDX-License-Identifier: GPL-3.0-or-later", "GPL-3.0-or-later"), ("SPDX-License-Identifier: (MIT OR Apache-2.0) AND LicenseRef-x", "(MIT OR Apache-2.0) AND LicenseRef-x"), ("SPDX-License-Identifier: GPL-2.0 WITH Classpath-exception-2.0.", "GPL-2.0 WITH Classpath-exception-2.0")])
def test_identifiers(line, name):
    assert [r[2] for r in licenses.scan_text(f"x\n{line}\ny = 1")] == [name]


def test_openings_that_licenses_share():
    assert [r[2] for r in licenses.scan_text(license_texts._BSD)] == ["BSD-2-Clause OR BSD-3-Clause"]
    assert [r[2] for r in licenses.scan_text(license_texts._ISC + ".")] == ["ISC OR 0BSD"]


def test_repeated_rows_with_licenses(spark):
    d = docs(spark, [(1, "Licensed under CC BY 4.0.")] * 3 + [(2, "Licensed under CC BY 4.0. " * 2)])
    for name in ("start", "stop", "license", "reduction", "differences"):
        d = d.withColumn(name, d["doc_id"])
    assert sorted((r.doc_id, r.start) for r in licenses.scan(d).collect()) == [(1, 0)] * 3 + [(2, 0), (2, 26)]
