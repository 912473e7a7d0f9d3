"""Personal data, licenses, SentencePiece ids, token-id files, mixing, the pipeline."""

import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from docloom.llm import common, idcoder, licenses, mixing, pieces, pii


def found(text):
    base, more = pii.spans_of(text)
    return [(k, text[s:e]) for s, e, k in base], [(k, text[s:e]) for s, e, k in more]


@pytest.mark.parametrize(
    ("text", "kind", "span"),
    [
        ("write to bob dot smith at mail dot example dot com please", "email", "bob dot smith at mail dot example dot com"), ("bob [at] example [dot] com", "email", "bob [at] example [dot] com"), ("x bob(at)example.com y", "email", "bob(at)example.com"),
        ("bob＠example．com", "email", "bob＠example．com"), ("see bоb@exаmple.com ok", "email", "bоb@exаmple.com"), ("jane_doe AT corp-mail DOT co DOT uk", "email", "jane_doe AT corp-mail DOT co DOT uk"),
        ("call plus one nine eight eight five five five two four eight five today", "phone", "plus one nine eight eight five five five two four eight five"), ("＋44 20 7946 0958", "phone", "＋44 20 7946 0958"),
        ("+1 (988) 555-24​85", "phone", "+1 (988) 555-24​85"), ("four one one one one one one one one one one one one one one one", "card", "four one one one one one one one one one one one one one one one"),
        ("pay 4l11 11I1 1111 1111 now", "card", "4l11 11I1 1111 1111"), ("one nine two dot one six eight dot zero dot one", "ip", "one nine two dot one six eight dot zero dot one"), ("at 10[.]0[.]0[.]1.", "ip", "10[.]0[.]0[.]1"), ("host 192 dot 168 dot 1 dot 20", "ip", "192 dot 168 dot 1 dot 20"),
        ("on 10 . 20 . 30 . 40 now", "ip", "10 . 20 . 30 . 40"), ("ring +1 (five five five) one two three-4567 ok", "phone", "+1 (five five five) one two three-4567"), ("mail john.smith at example.com", "email", "john.smith at example.com"),
        ("mail SMITH AT EXAMPLE.COM", "email", "SMITH AT EXAMPLE.COM"), ("zwei null vier eins neun sieben fünf sechs acht drei", "phone", "zwei null vier eins neun sieben fünf sechs acht drei"), ("192(dot)168(dot)1(dot)1", "ip", "192(dot)168(dot)1(dot)1"),
    ],
)
def test_disguises(text, kind, span):
    base, more = found(text)
    assert base == [] and more == [(kind, span)]


@pytest.mark.parametrize("text", ["", None, "the cat sat at the mat dot", "look at one two three things", "look at example.com for more", "un un un un un un un un un un un un", "one, two, three, four. Five", "Привет мир 123", "naïve café, 12 of 34.", "a @ b", "o ll 12 ll lo"])
def test_clean_texts_stay_clean(text):
    assert pii.spans_of(text) == ([], [])


def test_base_rules():
    text = "a.b@c-d.e.f, 1.2.3.4.5 300.1.1.1 x +1 (988) 555-2485 and +123"
    assert [x for x in found(text)[0] if x[0] != "card"] == [("email", "a.b@c-d.e.f"), ("ip", "1.2.3.4"), ("phone", "+1 (988) 555-2485")]
    assert found("a ll 30.92.97.236 ll lo 96.160.208.151 lo o") == ([("ip", "30.92.97.236"), ("ip", "96.160.208.151")], [])
    base = pii.spans_of("x 4111 1111 1111 1111. y 4111111111111112 z 1.2.3.256 w +1 (988) 555-2485")[0]
    assert [k for _, _, k in base] == ["card", "phone"]


LUHN = str.maketrans("0123456789", "0246813579")


def brute_base(text):
    """The base patterns as they are written, leftmost and not overlapping, each kind by itself."""
    out = [(m.start(), "email", m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", text)]
    out += [(m.start(), "ip", m.end()) for m in re.finditer(r"[0-9]+(?:\.[0-9]+){3}", text) if all(int(x) <= 255 for x in m.group().split("."))]
    for m in re.finditer(r"[0-9](?:[ -]?[0-9])+", text):
        d = [c for c in m.group() if c in "0123456789"]
        if 14 <= len(d) <= 19 and sum(int(c) if i % 2 == 0 else int(c.translate(LUHN)) for i, c in enumerate(reversed(d))) % 10 == 0:
            out.append((m.start(), "card", m.end()))
    out += [(m.start(), "phone", m.end()) for m in re.finditer(r"\+[0-9][ ().0-9-]+[0-9]", text) if 10 <= sum(c in "0123456789" for c in m.group()) <= 15]
    return sorted(out, key=lambda x: (x[0], ("email", "ip", "card", "phone").index(x[1])))


def test_spans_query(spark, sf_dir, texts):
    import hashlib

    got = {r.doc_id: r for r in pii.query(spark, sf_dir).collect()}
    for i, t in texts.items():
        base = ",".join(f"{k}:{s}:{e}" for s, k, e in brute_base(t))
        assert got[i].base_sha256 == hashlib.sha256(base.encode()).hexdigest() and got[i].spans == base
        assert (got[i].n_email, got[i].n_ip, got[i].n_card, got[i].n_phone) == tuple(sum(x.startswith(k) for x in base.split(",")) for k in ("email", "ip", "card", "phone"))


def test_base_spans_against_the_plain_patterns():
    rnd = random.Random(7)
    signs = ["a", "b.c", "@", "@", ".", "-", "+", "1", "12", "255", "256", "4111111111111111", " ", "%", "é", "+1", "(", ")", "1.2.3.4", "\n", "x@y.z"]
    for _ in range(20_000):
        t = "".join(rnd.choice(signs) for _ in range(rnd.randint(1, 14)))
        assert sorted((s, k, e) for s, e, k in pii.base_spans(t)) == sorted(brute_base(t)), t


@pytest.mark.parametrize("text", ["x" * 1_000_000 + " a@b.co", "1" * 1_000_000 + ".", "a.b" * 300_000 + " at b", "x@" * 400_000, " " * 1_000_000 + "@", "one" + " " * 1_000_000 + "two one three", "(" * 1_000_000 + "at", "a dot " * 150_000, "1 " * 400_000 + "x", "O1" * 400_000 + "x", "1." * 400_000, "+1" * 400_000, "one " * 200_000, "\t-" * 400_000 + "@",
    "x1@b.co y1 [at] b [dot] co " * 40_000, "a [at] b1 [dot] c, " * 55_000, "one two three four five six seven eight nine zero, +1 555 010 9999, " * 15_000, "a dot b dot c dot " * 60_000], ids=range(18))
def test_long_texts_take_linear_time(text):
    import time

    began = time.process_time()
    pii.spans_of(text)
    assert time.process_time() - began < 5


def test_addresses_of_many_parts():
    """As many as an address may have: 64 characters before the sign, 253 after it."""
    local, host = " dot ".join(["ab1"] + ["c"] * 30), " dot ".join(["d"] * 120 + ["example", "org"])
    text = f"write to {local} at {host} now"
    base, more = pii.spans_of(text)
    assert not base and more == [(9, len(text) - 4, "email")]
    assert pii.redact(text) == "write to <EMAIL> now"


def test_spans_met_by_many(monkeypatch):
    """Merging by search gives what comparing with every span gives."""
    rnd = random.Random(8)
    parts = ["x1@b.co ", "y1 [at] b [dot] co ", "one two three four five six seven eight nine zero ", "+44 20 1234 5678 ", "4111 1111 1111 1111 ", "10[.]0[.]0[.]1 ", "john dot smith at example dot com ", "+1 (2O3) 555-O199 ", "ab "]

    def slowly(text, base):
        first = pii.glyphs(text)
        step = first.text if first else text
        second, numbers = pii.disguises(step)
        if first is None and second is None:
            return []
        found = pii.base_spans(second.text if second else step)
        found += [(s, e, "phone") for s, e in numbers if not any(a < e and s < b for a, b, _ in found)]
        out = []
        for s, e, kind in found:
            s, e, changed = second.source(s, e) if second else (s, e, False)
            s, e, also = first.source(s, e) if first else (s, e, False)
            if (changed or also) and not any(k == kind and a < e and s < b and not (s <= a and b <= e and (s, e) != (a, b)) for a, b, k in base):
                out.append((s, e, kind))
        return out

    seen = 0
    for _ in range(1500):
        text = "".join(rnd.choice(parts) for _ in range(rnd.randint(1, 12)))
        base = pii.base_spans(text)
        assert pii.added_spans(text, base) == slowly(text, base)
        seen += len(pii.added_spans(text, base))
    assert seen > 1000


def test_redaction(edge, empty, spark):
    rows = spark.createDataFrame([(1, "to bob@x.com or bob at x dot com", 1), (2, None, 0), (3, "plain", 5)], "doc_id long, text string, n_chars long")
    assert [(r.text, r.n_chars) for r in pii.redacted(rows).orderBy("doc_id").collect()] == [("to <EMAIL> or <EMAIL>", 21), (None, None), ("plain", 5)]
    assert pii.redacted(edge).columns == edge.columns and pii.redacted(edge).count() == edge.count() and pii.redacted(empty).count() == 0
    assert pii.find(edge).count() == edge.count()


SCANNER = licenses.Scanner()


@pytest.mark.parametrize("i", range(len(licenses.TEMPLATES)))
def test_templates_are_found_in_place(i):
    name, _, text = licenses.TEMPLATES[i]
    whole = f"Some first line.\n{text}\nSome last line."
    hits = SCANNER.scan(whole)
    assert [h.license for h in hits] == [name] and hits[0].differences == []
    assert [w for w, _, _ in licenses.words_of(whole[hits[0].start : hits[0].end])] == [w for w, _, _ in licenses.words_of(text)]


def test_license_differences_and_near_misses():
    (text,) = [t for n, _, t in licenses.TEMPLATES if n == "MIT" and "substantial portions" in t]
    changed = text.replace("substantial portions", "significant parts").replace("free of charge", "at no cost")
    hits = SCANNER.scan("Copyright 2020 A. Body\n" + re.sub(r"(.{60}\S*) ", r"\1\n", changed))
    assert [h.license for h in hits] == ["MIT"] and "-substantial portions+significant parts" in hits[0].differences
    assert SCANNER.scan("Licensed under the Apache License, Version 1.1.") == []
    two = SCANNER.scan("Released under the MIT License. Licensed under CC BY-NC 4.0.")
    assert [h.license for h in two] == ["MIT", "CC-BY-NC-4.0"]
    assert SCANNER.scan(None) == SCANNER.scan("") == SCANNER.scan("He has a driving license and copyright law as a hobby.") == []


@pytest.mark.parametrize("name", licenses.FULL)
def test_whole_licenses_in_longer_texts(name):
    """A reworded copy of a whole license, between other words and after another license."""
    text = licenses._full(name)
    words = text.split(" ")
    for i in range(50, len(words), 97):
        words[i] = "otherwise"
    whole = f"{'Nothing to see here. ' * 300}\n{' '.join(words)}\n{'More of it. ' * 300}\nReleased under the MIT License."
    hits = SCANNER.scan(whole)
    assert [h.license for h in hits] == [name, "MIT"] and 5 < len(hits[0].differences) and hits[0].end - hits[0].start > 0.95 * len(text.strip())


def test_short_mentions():
    for text, wanted in (("// SPDX-License-Identifier: MIT", ["MIT"]), ("Apache Software License 2.0", ["Apache-2.0"]), ("GNU GENERAL PUBLIC LICENSE\n  Version 3, 29 June 2007", ["GPL-3.0"]), ("the terms of the Eclipse Public License 2.0 which is available at", ["EPL-2.0"]), ("Apache License\n Version 2.0, January 2004", ["Apache-2.0"])):
        got = [h.license for h in SCANNER.scan(text)]
        assert got == wanted or "Eclipse" in text and got in ([], wanted), text


def brute_licenses(text):
    """Each template, longest first, is compared with the stretch round each place where it could begin; all are compressed."""
    all_ = licenses.words_of(text)
    words, taken, out = [w for w, _, _ in all_], set(), []
    for t in SCANNER.templates:
        for i in [i for i, w in enumerate(words) if w == t.anchor]:
            if i in taken:
                continue
            more = -(-len(t.words) // 2) + 1
            s, e = i, i
            while s > max(0, i - t.last - more) and s - 1 not in taken:
                s -= 1
            while e < min(len(words), i - t.first + len(t.words) + more) and e not in taken:
                e += 1
            ranked = [k for saving, k in SCANNER.savings(words[s:e]) if saving >= licenses.LEAST_SAVING]
            met = [(m[2], -n, k, m) for n, k in enumerate(ranked) if (m := SCANNER.compare(words[s:e], SCANNER.templates[k]))]
            if met:
                _, _, k, m = max(met)
                taken |= set(range(s + m[0], s + m[1]))
                out.append((all_[s + m[0]][1], all_[s + m[1] - 1][2], SCANNER.templates[k].name))
    return sorted(out)


def test_scan_against_compressing_with_all_templates():
    rnd = random.Random(3)
    short = [t for _, _, t in licenses.TEMPLATES if len(t) < 400]
    agreed = total = 0
    for _ in range(60):
        parts = []
        for _ in range(rnd.randint(1, 5)):
            words = rnd.choice(short).split(" ")
            if rnd.random() < 0.4:
                words[rnd.randrange(len(words))] = rnd.choice(["the", "license", "public", "or"])
            parts += [" ".join(words), " ".join(rnd.choice(["sun", "license", "copy", "of", "the", "moon"]) for _ in range(rnd.randint(0, 12)))]
        text = ". ".join(parts)
        got, wanted = [(h.start, h.end, h.license) for h in SCANNER.scan(text)], brute_licenses(text)
        agreed += len(set(got) & set(wanted))
        total += len(set(got) | set(wanted))
    assert total > 100 and agreed >= 0.98 * total


@pytest.mark.parametrize("text", [licenses._full("GPL-3.0") * 30, "This program is licensed and the license of the software is a license under public general terms, copyright mit gnu apache 2.0. " * 8000, "Released under the MIT License. " * 30_000, "Das geht mit der license mit " * 35_000], ids=["whole", "talk", "notices", "keys"])
def test_long_license_talk(text):
    import time

    began = time.process_time()
    SCANNER.scan(text)
    assert time.process_time() - began < 5


def test_agreeing_stretches_of_long_lists():
    rnd = random.Random(2)
    b = [rnd.choice("abcdefghij") * rnd.randint(1, 4) for _ in range(3000)]
    a = list(b)
    for i in range(100, 3000, 150):
        a[i] = "other"
    a[500:500] = ["more"] * 20
    got = licenses.agreeing(a, b)
    assert all(a[i : i + n] == b[j : j + n] for i, j, n in got) and sum(n for _, _, n in got) >= 2970
    assert all(x[0] + x[2] <= y[0] and x[1] + x[2] <= y[1] for x, y in zip(got, got[1:]))


def test_license_query(spark, sf_dir, texts, edge, empty):
    got = {r.doc_id: r.licenses for r in licenses.query(spark, sf_dir).collect()}
    wanted = {"Released under the MIT License.": "MIT", "Licensed under the Apache License, Version 2.0.": "Apache-2.0", "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0", "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0"}
    for i, t in texts.items():
        places = sorted((m.start(), name) for s, name in wanted.items() for m in re.finditer(re.escape(s), t))
        assert [x.split(":")[0] for x in got[i].split(",") if x] == [n for _, n in places]
    assert licenses.scan(edge).count() == edge.count() and licenses.scan(empty).count() == 0


@pytest.fixture(scope="module")
def encoder():
    return pieces.Encoder(pieces.load(pieces.default_model()))


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())


def test_ids_are_the_library_s(encoder, library, texts):
    own = list(texts.values())
    for t, ids in zip(own, encoder.encode_many(own)):
        assert ids.tolist() == library.encode(t) and encoder.decode(ids) == t == library.decode(ids.tolist())


def test_odd_texts_and_streaming(encoder, library):
    rnd = random.Random(8)
    parts = ["a", "th", "the", " ", "  ", " " * 5, " " * 17, " " * 80, "\n", "\t", "é", "日", "🙂", "\x00", "ing", "123", "----", "▁", "<s>", "Ж", "zq"]
    for _ in range(3000):
        t = "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 12)))
        ids = encoder.encode(t)
        assert ids.tolist() == library.encode(t), t
        assert encoder.decode(ids) == library.decode(ids.tolist())
    long = "".join(rnd.choice("abcdeghinorstu") for _ in range(5000))
    assert encoder.walk("▁" + long) == library.encode(long)


def test_unigram_models_take_the_largest_sum():
    p = pieces.Pieces(["<unk>", "▁", "a", "b", "ab", "▁a", "ba", "aba"], [0, -2, -3, -3, -4, -4.5, -3.5, -6], [2, 1, 1, 1, 1, 1, 1, 1], False, True)
    e = pieces.Encoder(p)

    def best(t):
        if not t:
            return 0.0, []
        return max(((s + p.scores[p.ids[t[:n]]], [p.ids[t[:n]], *r]) for n in range(1, len(t) + 1) if t[:n] in p.ids for s, r in [best(t[n:])]), key=lambda x: x[0])

    for t in ("abab", "baba", "aabba", "abaabab"):
        assert sum(p.scores[i] for i in e.encode(t)) == pytest.approx(best("▁" + t)[0])


def test_piece_edges(edge, empty, encoder):
    got = pieces.encoded(edge, encoder.p).collect()
    assert len(got) == edge.count() and all(r.exact for r in got if r.exact is not None) and sum(r.exact is None for r in got) == 2
    assert pieces.encoded(empty, encoder.p).count() == 0


@pytest.mark.parametrize("n", [1, 2, 15, 17, 100, 5000, 70_001])
def test_blocks_round_trip(n):
    rnd = np.random.default_rng(n)
    for ids in (rnd.integers(0, 50_257, n), rnd.zipf(1.3, n) % 50_257, np.full(n, 7), np.arange(n) % 300):
        assert np.array_equal(idcoder.decode_block(idcoder.encode_block(ids, 50_257), n, 50_257), ids)


def test_model_learns_and_damage_shows():
    rnd = np.random.default_rng(0)
    words = rnd.integers(0, 50_000, (200, 3))
    ids = words[rnd.integers(0, 200, 100_000)].ravel()
    raw = idcoder.pack(0, 0, False, [(1, len(ids))], ids, 50_257)
    assert len(raw) * 8 / len(ids) < 7  # 15.6 bits for a plain id, 2.5 for the choice of a word
    broken = bytearray(raw + b"\n")
    broken[len(raw) // 2] ^= 1
    with pytest.raises(ValueError):
        list(idcoder.unpack(bytes(broken)))


def check_files(spark, df, path, monkeypatch, block=None, chars=None):
    from tokenizers import Tokenizer

    if block:
        monkeypatch.setattr(idcoder, "BLOCK", block)
    if chars:
        monkeypatch.setattr(idcoder, "FILE_CHARS", chars)
    idcoder.write_ids(df, path, idcoder.default_tokenizer())
    model = Tokenizer.from_file(idcoder.default_tokenizer())
    got = [(r.doc_id, r.n_tokens, r.ids_crc32) for r in idcoder.read_documents(spark, path).orderBy("part", "seq").collect()]
    wanted = []
    for r in sorted(df.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0)):
        ids = [*model.encode(r.text or "", add_special_tokens=False).ids, 2]
        wanted.append((r.doc_id, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    assert got == wanted or sorted(got, key=str) == sorted(wanted, key=str) and [g[0] for g in got] == [w[0] for w in wanted]


def test_files_of_ids(spark, documents, edge, empty, tmp_path, monkeypatch):
    check_files(spark, documents, f"file://{tmp_path}/a", monkeypatch, chars=100_000)
    check_files(spark, edge, f"file://{tmp_path}/b", monkeypatch, chars=1 << 24)
    idcoder.write_ids(empty, f"file://{tmp_path}/c", idcoder.default_tokenizer())
    assert idcoder.read_documents(spark, f"file://{tmp_path}/c").count() == 0


def test_added_tokens_are_one_id():
    """The library's own call, no switch of it set: the string of an added token is that token wherever it stands."""
    from tokenizers import Tokenizer

    texts = ["<|endoftext|>", "one <|endoftext|>two", "<|endoftext|><|endoftext|> é", "日本<|endoftext|>", "<|endoftext|", "plain words, 12 of them"]
    tokens, model = idcoder.Tokens(idcoder.default_tokenizer()), Tokenizer.from_file(idcoder.default_tokenizer())
    for _ in range(2):
        assert [x.tolist() for x in tokens.encode(pa.array(texts))] == [model.encode(t, add_special_tokens=False).ids for t in texts]
    assert [x.tolist() for x in tokens.encode(pa.array(texts[:1]))] == [[50256]]


def test_remembered_words_have_the_ids_of_whole_texts(monkeypatch):
    """Texts of blanks, line breaks, marks, letters and digits of many kinds in any order; also where words are forgotten."""
    from tokenizers import Tokenizer

    rnd = np.random.default_rng(5)
    signs = [" ", " ", " ", "\n", "\t", "\r", "\x0b", "\u00a0", "\u2003", "\u3000", "\x85", "\x1c", ".", ",", "###", "'s", "'", "_", "-", "a", "the", "Word", "words", "é", "日本", "ا", "12", "½", "²", "́", "😀", "x" * 70, "don't", "Ġ", "ǅ"]
    texts = ["".join(rnd.choice(signs, rnd.integers(0, 30))) for _ in range(3000)] + ["", " ", "  ", "\n", " a", "a ", "a\n\nb c", "a.\nB c.\n", "it's 's. 's"]
    monkeypatch.setattr(idcoder, "REMEMBERED", 300)
    tokens, model = idcoder.Tokens(idcoder.default_tokenizer()), Tokenizer.from_file(idcoder.default_tokenizer())
    for k in range(0, len(texts), 100):
        part = texts[k : k + 100]
        assert [x.tolist() for x in tokens.encode(pa.array(part))] == [model.encode(t, add_special_tokens=False).ids for t in part]


def test_steps_hold_few_bytes():
    texts = ["x" * n for n in (0, 30, 1, 2, 3, 4, 5, 0, 0, 0, 0, 12)]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])
    got = [b.column("text").to_pylist() for b in common.steps_of(batch, "text", 10, 3)]
    assert [t for g in got for t in g] == texts
    assert all(len(g) == 1 or len(g) <= 3 and sum(map(len, g)) <= 10 for g in got)


def test_documents_longer_than_a_block(monkeypatch):
    monkeypatch.setattr(idcoder, "BLOCK", 100)
    docs = [(1, 30), (2, 350), (None, 10), (3, 0), (4, 100), (5, 101)]
    writer = idcoder.BlockWriter(3, 1000)
    raw = b"".join(b + b"\n" for d, n in docs for b in writer.add(d, np.arange(n) % 1000)) + b"".join(b + b"\n" for b in writer.flush())
    got: list = []
    for part, first, goes_on, table, ids in idcoder.unpack(raw):
        at = 0
        for k, (d, n) in enumerate(table):
            if k == 0 and goes_on:
                got[-1][1].extend(ids[at : at + n])
            else:
                assert part == 3 and first + k == len(got)
                got.append((d, list(ids[at : at + n])))
            at += n
    assert got == [(d, [i % 1000 for i in range(n)]) for d, n in docs]


def test_rows_of_one_id_do_not_follow_splits(spark, tmp_path):
    """Null and repeated ids with different texts, read with few and with many splits, lie in one order."""
    rows = [(None if i % 3 else 7, f"text {i % 500} " * (i % 5 + 1)) for i in range(3000)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    got = []
    for most in ("128m", "4k"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", most)
        spark.conf.set("spark.sql.files.openCostInBytes", most)
        got.append(sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in idcoder.query(spark, str(tmp_path)).collect()))
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert got[0] == got[1] and len(got[0]) == 3000


def test_token_query(spark, sf_dir, documents):
    got = {r.doc_id: r for r in idcoder.query(spark, sf_dir).collect()}
    start = 0
    for i in sorted(got):
        assert got[i].start == start
        start += got[i].n_tokens
    assert len(got) == documents.count()


def brute_targets(sizes, weights=(5, 2, 1), cap=3):
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    out, free, left = {}, set(names), sum(sizes.values())
    while free:
        total = sum(w[s] for s in free)
        over = {s for s in free if left * w[s] / total > cap * sizes[s]}
        if not over:
            return out | {s: left * w[s] / total for s in free}
        out |= {s: cap * sizes[s] for s in over}
        left -= sum(cap * sizes[s] for s in over)
        free -= over
    return out


@pytest.mark.parametrize("sizes", [{"a": 100, "b": 10, "c": 1000, "d": 5, None: 7}, {"x": 0, "y": 50}, {"only": 9}, {f"s{i}": (i * 37) % 91 for i in range(40)}, {"z": 0}])
def test_targets(spark, sizes):
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    assert {r.source: r.target for r in mixing.targets(df).collect()} == pytest.approx(brute_targets(sizes))


def test_mix(spark, documents):
    rows = mixing.mix(documents).collect()
    again = {r.doc_id: r.copies for r in mixing.mix(documents.repartition(5)).collect()}
    assert again == {r.doc_id: r.copies for r in rows}
    sources = {r.doc_id: r.source for r in documents.select("doc_id", "source").collect()}
    sums: dict = {}
    for r in rows:
        assert 0 <= r.copies <= 3 and abs(r.copies - r.target / r.source_size) < 1
        s = sums.setdefault(sources[r.doc_id], [0, r.target, 0])
        s[0] += r.copies * r["size"]
        s[2] = max(s[2], r["size"])
    assert all(abs(taken - target) <= 2 * most + 1 for taken, target, most in sums.values())


def test_mix_against_sql(spark, sf_dir):
    import duckdb

    from docloom.llm.queries import ORACLE_SQL

    c = duckdb.connect()
    c.sql(f"create view documents as select * from '{sf_dir}/documents.parquet'")
    columns = "doc_id, size, source_size, target, taken"
    wanted = c.sql(f"select {columns} from ({ORACLE_SQL['op4_mixing']}) order by doc_id").fetchall()
    assert [tuple(r) for r in mixing.query(spark, sf_dir).select(*columns.split(", ")).orderBy("doc_id").collect()] == wanted


def test_mix_edges(edge, empty):
    got = mixing.mix(edge).collect()
    assert len(got) == edge.count() and {r["size"] for r in got if r.doc_id in (1, 2, 3)} == {0}
    assert mixing.mix(empty).count() == 0 and mixing.mixed(empty).count() == 0
    assert mixing.mixed(edge).columns == edge.columns
    assert mixing.mixed(edge).count() == sum(r.copies for r in got)


def test_stages_do_not_depend_on_splits(spark, documents, tmp_path):
    """One table, read with few and with many splits for each file, gives the same rows."""
    from docloom.llm import simhash_dedup

    # 3,000 rows that tie in source, size and id.
    ties = spark.range(3000).selectExpr("cast(null as long) doc_id", "concat('tied text number ', id, ' of many') text", "'en' lang", "'src1' source", "10L n_chars")
    documents.unionByName(ties).repartition(3).write.parquet(f"{tmp_path}/t")
    got = []
    for most in ("128m", "20k"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", most)
        spark.conf.set("spark.sql.files.openCostInBytes", most)
        docs = spark.read.parquet(f"{tmp_path}/t")
        kept, mix = simhash_dedup.drop_near_duplicates(docs), mixing.mixed(docs)
        got.append([sorted((tuple(r) for r in df.collect()), key=repr) for df in (kept, mix)])
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert got[0] == got[1]


def test_pipeline_against_its_parts(spark, sf_dir, texts, library):
    import corpus_pipeline

    kept = [i for i, t in texts.items() if re.search(r"[^\W\d_]", t)]
    docs, seen = spark.read.parquet(f"{sf_dir}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.stash(stage(spark, docs, sf_dir), name)
        seen[name] = docs.collect()
        if name != "token_ids":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    lang = {r.doc_id for r in seen["language"]}
    assert lang <= set(kept) and len(lang) >= 0.98 * len(kept)
    from tests.llm.test_dedup import brute_similar

    assert {r.doc_id for r in seen["near_dedup"]} == set(brute_similar({i: texts[i] for i in lang}).values())
    clean = {r.doc_id: r.text for r in seen["personal_data"]}
    assert clean == {r.doc_id: pii.redact(texts[r.doc_id]) for r in seen["near_dedup"]} and all(r.n_chars == len(r.text) for r in seen["personal_data"])
    assert all(r.text == clean[r.doc_id] for r in seen["source_mix"])
    ids = sorted((r.doc_id, tuple(r.ids)) for r in seen["token_ids"])
    assert ids == sorted((r.doc_id, tuple(library.encode(r.text))) for r in seen["source_mix"]) and all(r.exact for r in seen["token_ids"])
    assert sorted((r.doc_id, tuple(r.ids)) for r in corpus_pipeline.run(spark, sf_dir).collect()) == ids


def test_pipeline_edges(spark, edge, empty):
    import corpus_pipeline

    for docs in (edge, empty):
        for name, stage in corpus_pipeline.STAGES:
            docs = corpus_pipeline.stash(stage(spark, docs, ""), name)
        assert docs.columns == ["doc_id", "n_ids", "ids", "exact"]
