"""Language, token counts, repeats, chat, token files, licenses, leaks: brute force and odd input."""

import hashlib
import random
import textwrap
import zlib

import numpy as np
import pytest

from bitweave.llm import chat, decontaminate, language_id, licenses, repeats, token_counts, token_files, word_encoder

BYTES, WORDS = token_counts.tokenizer_path("byte_bpe_50k.json"), token_counts.tokenizer_path("word_bpe_49k.json")


def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string")


# ---- language ----


def cross_parse(train: str, text: str, block: int) -> int:
    b, t, n = text.encode(), train.encode(), 0
    for lo in range(0, len(b), block):
        part, i = b[lo : lo + block], 0
        while i < len(part):
            k = 1
            while i + k < len(part) and part[i : i + k + 1] in t:
                k += 1
            i += k
            n += 1
    return n


def test_phrases_are_longest_matches():
    random.seed(4)
    samples = [("a", "".join(random.choice("abcd ") for _ in range(300))), ("b", "".join(random.choice("cdef ") for _ in range(200)))]
    m = language_id.Model(samples)
    texts = ["".join(random.choice("abcdefz ") for _ in range(n)) for n in (1, 7, 60, 500)]
    got = m.phrases([t.encode() for t in texts], 64)
    assert got.tolist() == [[cross_parse(s, t, 64) for _, s in samples] for t in texts]


def test_languages_held_out(spark, odd_documents):
    rng = random.Random(5)
    sy = {"en": ["the", "ing", "and", "er", "on", "th"], "de": ["sch", "ein", "ung", "der", "ich", "ä"], "fr": ["eau", "que", "les", "é", "ou", "tion"]}
    rows = [(i, " ".join("".join(rng.choice(sy[k]) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(5, 60))), k, "s") for i, k in enumerate(rng.choice(list(sy)) for _ in range(300))]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {r.doc_id: r for r in language_id.identify(d).collect()}
    held = [i for i, *_ in rows if zlib.crc32(str(i).encode()) % 3 == 1]
    assert held and all(got[i].held_out for i in held) and sum(r.held_out for r in got.values()) == len(held)
    assert np.mean([got[i].lang_pred == rows[i][2] for i in held]) > 0.97
    odd = language_id.identify(odd_documents).collect()
    assert len(odd) == 10 and all(r.lang_pred == "und" and r.score == 0 for r in odd if r.doc_id in (1, 2, 5, 6)) and all(0 <= r.score <= 1 for r in odd)
    assert language_id.identify(empty(spark)).count() == 0
    kept = language_id.keep(odd_documents, language_id.training_sample(odd_documents, "doc_id", "text", "lang"))
    assert kept.columns == odd_documents.columns and {r.doc_id for r in kept.collect()}.isdisjoint({1, 2, 5, 6})
    assert {r.lang_pred for r in language_id.predict(odd_documents, []).collect()} == {"und"}


# ---- token counts ----


def test_spliced_encoding_equals_whole():
    tok = token_counts.tokenizer(BYTES)
    rng = random.Random(6)
    pieces = ["hello", " world", "  ", "\n\n", "'s", "été", "日本語", "1234567", "<|endoftext|>", "!!!", "x" * 90, " " * 70, "\t", "don't", "á"]
    for n in range(25):
        t = "".join(rng.choice(pieces) for _ in range(rng.randint(1, 300)))
        for chunk, overlap in ((64, 16), (200, 40), (33, 8)):
            assert token_counts.encode_spliced(tok, t, chunk, overlap) == tok.encode(t, add_special_tokens=False).ids
    for t in ("y" * 3000, " " * 3000, "<|endoftext|>" * 200, "ab " * 1000):
        assert token_counts.encode_spliced(tok, t, 100, 10) == tok.encode(t, add_special_tokens=False).ids


def test_counts_of_odd_documents(spark, odd_documents):
    tok = token_counts.tokenizer(BYTES)
    want = sorted((-1 if r.doc_id is None else r.doc_id, len((r.text or "").encode()), len(tok.encode(r.text or "", add_special_tokens=False).ids)) for r in odd_documents.collect())
    got = token_counts.token_counts(odd_documents, BYTES, chunk=5000, overlap=100)
    assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_bytes, r.n_tokens) for r in got.collect()) == want
    assert token_counts.token_counts(empty(spark), BYTES).count() == 0


# ---- repeats ----


def brute_repeats(texts, length):
    from collections import Counter

    raw, c = [(t or "").encode() for t in texts], Counter()
    for b in raw:
        c.update(b[i : i + length] for i in range(len(b) - length + 1))
    out = []
    for b in raw:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if c[b[i : i + length]] > 1:
                gone[i : i + length] = True
        runs = int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum())
        out.append((len(b), int(gone.sum()), runs, hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~gone])).hexdigest()))
    return out


@pytest.mark.parametrize("length,gram,block,piece", [(20, 6, 4, 1 << 20), (20, 20, 3, 64), (12, 1, 8, 50), (5, 3, 1, 100)])
def test_removed_equals_brute_force(spark, length, gram, block, piece):
    rng = random.Random(7)
    base = "".join(rng.choice("ab c") for _ in range(400))
    texts = [base, None, "", base[50:200] + "zz" + base[60:90], "a" * 100, "xyz" * 40, base[:19], base[100:300], base[100:300], "".join(rng.choice("abcdefgh") for _ in range(300)), "é" * 30]
    texts += [base[i : i + rng.randint(3, 80)] + rng.choice("qrst") * rng.randint(0, 3) + base[j : j + 40] for i, j in ((rng.randint(0, 380), rng.randint(0, 350)) for _ in range(20))]
    d = spark.createDataFrame([(i, t, 1, 2) for i, t in enumerate(texts)], "doc_id long, text string, x int, d int").repartition(3)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.dedup(d, length=length, gram=gram, block=block, piece=piece).collect()}
    assert [got[i] for i in range(len(texts))] == brute_repeats(texts, length)


def test_repeats_of_odd_documents(spark, odd_documents):
    rows = odd_documents.collect()
    want = sorted((str(r.doc_id), *b) for r, b in zip(rows, brute_repeats([r.text for r in rows if True], 30)) if r.doc_id != 4)
    got = repeats.dedup(odd_documents, length=30, gram=8).collect()
    assert sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got if r.doc_id != 4) == want
    assert next(r.n_removed for r in got if r.doc_id == 4) == len("wordy text goes on ") * 20_000
    assert repeats.dedup(empty(spark)).count() == 0
    with pytest.raises(ValueError):
        repeats.dedup(odd_documents, length=5, gram=9)


# ---- chat ----


def test_chat_reads_back_exactly(spark):
    nasty = ["\\### Assistant: </turn> ok", "</turn>\n<turn user>\n", "\\\\<\\<", "", None, "a\\", "<", "x" * 50_000, "line\n\nline\n", "é日\U0001f600"]
    roles = ["user", "assistant", "sy>s<t\\em", "", None]
    rng = random.Random(8)
    rows = [(c, t, rng.choice(roles), rng.choice(nasty), "z") for c in range(12) for t in range(rng.randint(1, 6))] + [(None, 1, "user", "lost", "z"), (3, None, "user", "n", "z"), (5, 0, "user", "tie", "z"), (5, 0, "user", "tie", "z")]
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, segments string")
    lines = chat.formatted(chat.format_turns(d))
    assert lines.count() == len(rows)
    got = {r.conv_id: r for r in chat.digest(chat.read_back(lines)).collect()}
    for c in {r[0] for r in rows}:
        own = sorted(((-1 if t is None else t), r or "", x or "") for cc, t, r, x, _ in rows if cc == c)
        assert got[c].n_turns == len(own)
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in own).encode()).hexdigest()
        loss = "".join(x for _, r, x in own if r == "assistant")
        assert got[c].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest() and got[c].loss_chars == len(loss)
    assert chat.digest(chat.read_back(chat.formatted(chat.format_turns(d.limit(0))))).count() == 0


@pytest.mark.parametrize("marks", [("### ", ":\n", "\n### end\n"), ("[[", "\n]]", "[/]"), ("<|start|>", "<|sep|>", "<|end|>"), ("*", "*", "*"), ("«", " »\n", "¶")])
def test_any_template_reads_back(spark, marks):
    t = chat.Template(*marks)
    nasty = [*marks, "".join(marks), "\\" + marks[1], marks[2] + marks[0] + "user" + marks[1], "\\", "\\\\" + marks[2], "x" + marks[0][:1], "", "\n", " a \n"]
    rows = [(1, i, r, x) for i, (r, x) in enumerate((r, x) for r in ("user", "assistant", marks[1], "a" + marks[0], "\n") for x in nasty)]
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    lines = chat.formatted(chat.format_turns(d, t))
    got = chat.read_back(lines, t).orderBy("pos").collect()
    assert [(r.role, r.text) for r in got] == [(r, x) for _, _, r, x in rows]
    with pytest.raises(ValueError):
        chat.Template("\n", ">", "x")


def test_chat_moves(spark):
    d = spark.createDataFrame([(1, 0, "system", "s"), (1, 1, "user", "u"), (1, 2, "assistant", "a"), (2, 0, "assistant", "a"), (2, 1, "user", "u"), (2, 2, "user", "u")], "conv_id long, turn long, role string, text string")
    assert [(r.conv_id, r.turn_ok) for r in chat.format_turns(d).orderBy("conv_id", "pos").collect()] == [(1, True), (1, True), (1, True), (2, False), (2, True), (2, False)]
    assert [r.turn_ok for r in chat.format_turns(d, chat.Template(finals=("user",))).orderBy("conv_id", "pos").collect()] == [True, True, False, False, True, False]
    segments = chat.format_turns(d).where("conv_id = 1 and pos = 3").first().segments
    assert [s.loss for s in segments] == [False, True, False]


# ---- token files ----


def test_pack_round_trip():
    rng = np.random.default_rng(9)
    counts = rng.integers(0, 9, 50)
    ranks = (rng.random(counts.sum()) ** 6 * 2**31).astype(np.uint32)
    ctrl, data = token_files.pack(ranks, counts)
    assert (token_files.unpack(ctrl, data, counts) == ranks).all()
    assert token_files._data_bytes(ctrl, counts) == len(data)


def test_words_equal_library():
    e = word_encoder.WordEncoder(WORDS, bits=8)  # a table so small that it fills up
    rng = random.Random(10)
    odd = ["", "aaaa aaaaaaa", "<|endoftext|> x", "naïve Ünïçödé ÇÇ. straße", "ΣΑΣ ός", "it's don't WE'LL", "á é", "日本語 テキスト", "x" * 500, "a,b.c ,. ..., hello,, wörld.", "\x00 nul\x00x", "tab\tand\x0bvt nbsp em x", "İstanbul ıx", "Ǆ ǆ ĸ ŉ ſ", "１２３ ½ ²", "ªº µ ß ×÷ é×", ".", ",", "..", "é.", "é,."]
    texts = odd + ["".join(rng.choice("abéß.,' \nAB1") for _ in range(rng.randint(0, 200))) for _ in range(60)]
    want = e.whole(texts)
    ids, n = e.encode(texts)
    assert np.array_equal(ids, np.concatenate(want)) and n.tolist() == [len(w) for w in want]


@pytest.mark.parametrize("path", [WORDS, BYTES])
def test_files_round_trip(spark, odd_documents, tmp_path, path):
    folder = f"file://{tmp_path}/f"
    assert word_encoder.by_words(path) == (path == WORDS)
    files = token_files.write(odd_documents, folder, path, shards=3, file_ids=50)
    tok, at = token_counts.tokenizer(path), 0
    rows = sorted(odd_documents.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0))
    full = sorted(token_files.read(spark, folder, files).collect(), key=lambda r: r.start)
    short = {r.start: r for r in token_files.read(spark, folder, files, digests=True).collect()}
    assert len(full) == len(rows) and len(files) > 1
    for r, g in zip(rows, full):
        ids = tok.encode(r.text or "", add_special_tokens=False).ids + [2]
        assert (g.doc_id, g.start, g.n_tokens) == (r.doc_id, at, len(ids)) and list(g.ids) == ids
        assert short[at].ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        at += len(ids)
    none = token_files.write(empty(spark), f"file://{tmp_path}/e", WORDS)
    assert token_files.read(spark, f"file://{tmp_path}/e", none, digests=True).count() == 0


# ---- licenses ----


def test_licenses(spark, odd_documents):
    cases = {
        "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0", "Licensed under CC BY 4.0": "CC-BY-4.0", "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0", "under the terms of the GNU General Public License v2": "GPL-2.0",
        "Licensed under the Apache License, Version 2.0.": "Apache-2.0", "Released under the MIT License.": "MIT", "(c) 2020 X. All rights reserved.": "All-Rights-Reserved", "GNU Lesser General Public License version 3": "LGPL",
    }
    s = licenses.Scanner()
    for text, name in cases.items():
        assert {x[2] for x in s.find(text)} == {name}, text
    assert s.find("a licence to drive is not a template") == []
    assert licenses.wording("the apache software license version 2.0".split(), "apache license version 2.0".split()) == [(1, 5, ["software"])]
    rows = [(i, ("some text before\n" * 3) + t + "\nand after") for i, t in enumerate(cases)] + [(99, "nothing here"), (100, None), (101, "")]
    d = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, license int")
    got = {r.doc_id: r for r in licenses.scan(d).collect()}
    assert {i: r.license for i, r in got.items()} == dict(enumerate(cases.values()))
    assert rows[0][1][got[0]["from"] : got[0]["to"]] == "CC BY-NC 4.0"
    assert licenses.scan(odd_documents).count() == 0 and licenses.documents(licenses.scan(empty(spark))).count() == 0


def test_licenses_that_are_named_together_or_denied():
    s = licenses.Scanner()
    of = lambda t: {x[2] for x in s.find(t) if not x[5]}
    assert of("Dual licensed under the MIT License or the Apache License, Version 2.0.") == {"MIT", "Apache-2.0"}
    assert of("Licensed under CC BY 4.0 (text) and GPL-3.0 (code); all rights reserved for logos.") == {"CC-BY-4.0", "GPL-3.0", "All-Rights-Reserved"}
    assert of("This project is NOT under the MIT License.") == set() and [x[2] for x in s.find("This project is NOT under the MIT License.")] == ["MIT"]
    assert of("It is not finished. Released under the MIT License.") == {"MIT"}
    grant = next(t.text for t in licenses.TEMPLATES if t.name == "MIT")
    text = "MIT License\n\nCopyright (c) 2020 Somebody\n\n" + textwrap.fill(grant, 72) + "\n\nAnd then some more prose of another kind."
    found = s.find(text)
    whole = max(found, key=lambda x: x[1] - x[0])
    assert {x[2] for x in found} == {"MIT"} and text[whole[0] : whole[1]].startswith("Permission is") and text[whole[0] : whole[1]].endswith("SOFTWARE") and whole[3] > 0.5 and whole[4] == ""
    changed = text.replace("free of charge", "for a fee").replace("sublicense", "sublicence")
    whole = max(s.find(changed), key=lambda x: x[1] - x[0])
    assert {"-free", "-charge", "+fee", "-sublicense", "+sublicence"} <= set(whole[4].split())
    half = "Copyright (c) 2020 Somebody\n\n" + " ".join(grant.split()[:60])
    assert of(half) == set()


def test_license_blocks_equal_all_windows():
    """Windows around license words find what all windows of the text find with every template."""
    rng = random.Random(15)
    s, pool = licenses.Scanner(), [t.text for t in licenses.TEMPLATES] + [p for t in licenses.TEMPLATES for p in t.phrases]
    n = 0
    for _ in range(40):
        parts = []
        for _ in range(rng.randint(1, 5)):
            parts.append(" ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9))) for _ in range(rng.randint(0, 400))))
            own = rng.choice(pool).split()
            parts.append(" ".join(w for w in own if rng.random() > 0.03))
        text = textwrap.fill(" ".join(parts), rng.choice([50, 80, 100_000]))
        a, b = s.find(text), s.find(text, every=True)
        assert [(x[:3], x[4:]) for x in a] == [(x[:3], x[4:]) for x in b]
        n += len(a)
    assert n > 60


def test_every_license_of_a_text(spark):
    texts = {0: "SPDX-License-Identifier: MIT OR Apache-2.0", 1: "Released under the MIT License.\nLicensed under the Apache License, Version 2.0.", 2: "all of it is GPLv3", 3: "the GNU General Public License, version 3, or the GNU Lesser General Public License"}
    want = {0: {"MIT", "Apache-2.0"}, 1: {"MIT", "Apache-2.0"}, 2: {"GPL-3.0"}, 3: {"GPL-3.0", "LGPL"}}
    for t in licenses.TEMPLATES:
        for wide in (10_000, 76, 30):
            texts[n := len(texts)] = textwrap.fill(t.text, wide)
            want[n] = {t.name}
    got = {i: set() for i in texts}
    for r in licenses.scan(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect():
        got[r.doc_id].add(r.license)
    assert not {i: (got[i], want[i]) for i in texts if not want[i] <= got[i]}
    assert got[0] == want[0] and got[2] == want[2] and got[3] == want[3]


# ---- leaks ----


def fewest_edits(p: bytes, t: bytes) -> int:
    prev = [0] * (len(t) + 1)
    for j, c in enumerate(p, 1):
        cur = [j]
        for i, x in enumerate(t, 1):
            cur.append(min(prev[i - 1] + (c != x), prev[i] + 1, cur[i - 1] + 1))
        prev = cur
    return min(prev)


def test_leaks_equal_brute_force():
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8)))
    items = [(i, " ".join(word() for _ in range(rng.randint(4, 40)))) for i in range(12)] + [(50, "short"), (51, "A, b; " * 20)]
    ix = decontaminate.Index(items, 64, 32, 0.05, 32)
    docs = [""]
    for _ in range(50):
        y = list(rng.choice(items)[1])
        for _ in range(rng.randint(0, 9)):
            p, o = rng.randrange(len(y)), rng.random()
            y[p : p + 1] = [] if o < 0.3 else [rng.choice("xyz ")] if o < 0.6 else [y[p], rng.choice("xyz")]
        docs.append(" ".join(word() for _ in range(5)) + " " + "".join(y).upper() + "!! " + word())
    raw = [d.encode() for d in docs]
    got = {(r.doc, r.item): r.edits for r in ix.matches(raw).itertuples()}
    buf, st = decontaminate.normalise(raw)
    want = {}
    for d in range(len(docs)):
        own = bytes(buf[st[d] : st[d + 1] - 1])
        for a, m, i, k in zip(ix.at, ix.size, ix.item, ix.edits):
            e = fewest_edits(bytes(ix.buf[a : a + m]), own)
            if e <= k:
                want[d, i] = min(e, want.get((d, i), 99))
    assert got == want and len(want) > 10


def test_leaks_of_odd_documents_and_blocks(spark, odd_documents):
    bench = spark.createDataFrame([(1, "the cat sat on the mat and the dog sat on the log", 5), (2, None, 5), (3, "", 5), (None, "der hund und die katze sind nicht hier", 5), (4, "der hund und die katze sind nicht hier", 5), (4, "der hund und die katze sind nicht hier", 5)], "item_id long, text string, k int")
    for size in (1 << 20, 10):
        got = decontaminate.scan(odd_documents, bench, block_bytes=size).collect()
        assert sorted(((-1 if r.doc_id is None else r.doc_id), tuple(r["items"])) for r in got if r.contaminated) == [(0, (1,)), (3, (4,)), (3, (4,))] and len(got) == 10
        left = decontaminate.clean(odd_documents, bench, block_bytes=size)
        assert left.columns == odd_documents.columns and left.count() == 7
    assert decontaminate.scan(empty(spark), bench).count() == 0
    assert decontaminate.scan(odd_documents, bench.limit(0)).where("contaminated").count() == 0
