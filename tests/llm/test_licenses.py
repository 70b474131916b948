import random
import textwrap

from cellforge.llm import license_scan


def noise(rng, n):
    return " ".join("".join(rng.choice("abcdefghijklm") for _ in range(rng.randrange(2, 9))) for _ in range(n))


def found(text):
    """(start, end, license, missing words) of a text's notices."""
    scanner = license_scan.Scanner(license_scan.TEMPLATES)
    return sorted((s + x, s + y, name, missing) for s, e in license_scan.blocks(text) for x, y, name, _, missing in scanner.scan(text[s:e]))


def test_notices_in_running_prose(spark):
    rng = random.Random(3)
    rows = [(6, "y " * 10_000 + license_scan.TEMPLATES["GPL-3.0-line"] + " z" * 10_000, "GPL-3.0-line")]
    for name, notice in license_scan.TEMPLATES.items():
        for words in (3, 10, 40, 300):
            rows.append((len(rows) + 10, f"{noise(rng, words)} {notice} {noise(rng, words)}", name))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    got = {r.doc_id: (r.license, r.missing_words, r.start, r.end) for r in license_scan.scan(docs).collect()}
    at = {i: text.index(license_scan.TEMPLATES[name]) for i, text, name in rows}
    assert got == {i: (name, 0, at[i], at[i] + len(license_scan.TEMPLATES[name])) for i, _, name in rows}


def test_wrapped_notices_and_spdx_lines():
    for name, notice in license_scan.TEMPLATES.items():
        if name.endswith("-spdx"):
            continue
        for mark in ("", " * ", "# ", "// ", "\t;; "):
            for width in (30, 72):
                head = f"{mark}some file\n{mark}\n"
                text = head + textwrap.fill(notice, width, initial_indent=mark, subsequent_indent=mark, break_long_words=False) + "\n\nint main() {}\n"
                assert [f[2:] for f in found(text)] == [(name, 0)], text
    upper = license_scan.TEMPLATES["BSD-2-Clause"].upper().replace(" MODIFICATION", " CHANGE")
    assert [f[2:] for f in found(upper)] == [("BSD-2-Clause", 1)]
    for line, want in [("MIT", ["MIT"]), ("GPL-2.0-or-later", ["GPL-2.0"]), ("GPL-3.0+", ["GPL-3.0"]), ("BSD-3-Clause", []), ("BSD-2-Clause-Patent", []), ("MITNFA", []), ("Zlib", [])]:
        text = f"// SPDX-License-Identifier: {line}\n// the mit and the isc met\n"
        assert [f[2] for f in found(text)] == [f"{w}-spdx" for w in want], line
    assert not found(license_scan.TEMPLATES["LGPL-3.0"].replace("version 3", "version 2.1"))


def test_several_notices_and_long_lines():
    t = license_scan.TEMPLATES
    rng = random.Random(8)
    dual = f"{t['MIT-line']} {t['CC-BY-4.0-line']} {t['MIT']}\n{t['Apache-2.0-line']} {t['MIT-line']}"
    assert [f[2] for f in found(dual)] == ["MIT-line", "CC-BY-4.0-line", "MIT", "Apache-2.0-line", "MIT-line"]
    assert [f[2] for f in found("/* SPDX-License-Identifier: (MIT OR Apache-2.0) AND CC-BY-NC-4.0 */")] == ["MIT-spdx", "Apache-2.0-spdx", "CC-BY-NC-4.0-spdx"]
    # a notice at any distance from a trigger before it, past each way that a line could be cut
    for name in ("Apache-2.0", "MIT", "ISC", "GPL-3.0"):
        for gap in range(1700, 2300, 40):
            text = "a license " + noise(rng, 1000)[:gap] + f" {t[name]} " + noise(rng, 1000)
            at = text.index(t[name])
            assert found(text) == [(at, at + len(t[name]), name, 0)]
    for gap in range(license_scan.REACH - 400, license_scan.REACH + 400, 80):
        text = "a license " + noise(rng, 1500)[:gap] + f" {t['MIT']} " + noise(rng, 1000)
        assert [f[2] for f in found(text)] == ["MIT"]
    many = f"{t['MIT-line']} {noise(rng, 5)}\n" * 500
    assert [f[2] for f in found(many)] == ["MIT-line"] * 500
