"""Packing, mixing, archives, media, page text and search: round trips and brute force."""

import collections
import hashlib
import html.parser
import random
import re
import time
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from weftgraph.llm import ann, htmltext, media, mixing, packing, warc

TEXTS = [None, "", "word", "Don't stop: it's 12 o'clock!", "日本 語 ª½ İ <|endoftext|>x", "a\x1cb", "naïve café Straße " * 900, "x" * 3000]


def test_packing(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.vocabulary())
    rows = [(i, t) for i, t in enumerate(TEXTS * 3)] + [(None, "no id"), (5, TEXTS[5])]
    found = packing.pack(spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, start int, offset string")).collect()
    own = collections.defaultdict(list)
    for r in found:
        own[r["doc_id"]].append(r)
    for i, text in rows:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        covered = np.zeros(len(ids), int)
        for r in own[i]:
            part = slice(r["start"], r["start"] + r["length"])
            covered[part] += 1
            assert (r["doc_tokens"], r["ids_crc32"]) == (len(ids), zlib.crc32(ids[part].tobytes()))
        assert set(covered) == {sum(j == i for j, _ in rows)}  # rows that repeat are packed each
    sequences = collections.defaultdict(list)
    for r in found:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048 and at & (at - 1) == 0
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@given(st.lists(st.integers(1, 200), max_size=60), st.sampled_from([16, 64]))
@settings(max_examples=100, deadline=None)
def test_sequences_are_filled(lengths, capacity):
    doc, start, size, seq, offset = packing.filled(np.array(lengths, np.int64), capacity)
    own = collections.defaultdict(list)
    for d, s, n, q, o in zip(doc, start, size, seq, offset):
        own[d].append((s, n))
    assert {d: sum(n for _, n in p) for d, p in own.items()} == dict(enumerate(lengths))
    for parts in own.values():
        parts.sort()
        assert all(s + n == t for (s, n), (t, _) in zip(parts, parts[1:])) and parts[0][0] == 0
    sums = collections.Counter()
    for q, o, n in sorted(zip(seq, offset, size)):
        assert sums[q] == o
        sums[q] += n
    assert all(n <= capacity and n & (n - 1) == 0 for n in sums.values()) and sum(n < capacity for n in sums.values()) <= capacity.bit_length()


def test_few_documents_are_cut():
    lengths = np.random.RandomState(2).randint(1, 2049, 4000)
    doc, *_, seq, _ = packing.filled(lengths)
    assert len(doc) < len(lengths) + seq.max() + 20  # each sequence cuts one document at most


@given(st.lists(st.integers(0, 1000), min_size=1, max_size=8), st.integers(0, 200))
@settings(max_examples=60, deadline=None)
def test_sainte_lague(votes, seats):
    given_ = mixing.sainte_lague([float(v) for v in votes], seats)
    plain = [0] * len(votes)
    for _ in range(seats if sum(votes) else 0):
        best = max((i for i in range(len(votes)) if votes[i]), key=lambda i: (votes[i] / (2 * plain[i] + 1), -i))
        plain[best] += 1
    assert given_ == plain


def test_mixing(spark):
    rnd = random.Random(2)
    rows = [(i, " ".join(["w"] * rnd.randint(0, 60)), rnd.choice(["b", "a", None, "Z"] + ["a"] * 6), i) for i in range(400)] + [(7, "w w", "a", 0), (None, "w\tw\x0bw", "b", 0), (9, None, "b", 0)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long")
    for shard in (1 << 20, 500):
        found = mixing.mix(frame, shard_words=shard).collect()
        assert sorted(map(tuple, found), key=repr) == sorted(map(tuple, mixing.mix(frame.repartition(7), shard_words=shard).collect()), key=repr)
        by = collections.defaultdict(list)
        for r in found:
            assert 0 <= r["taken"] <= 3 * r["size"]
            by[r["source"]].append(r)
        total = sum(r["size"] for r in found)
        names = ["Z", "a", "b", None]
        want = mixing.targets([sum(r["size"] for r in by[n]) for n in names], [1, 2, 3, 1])
        for n, target in zip(names, want):
            assert abs(by[n][0]["target"] - target) < 1e-6 and abs(sum(r["taken"] for r in by[n]) - target) <= 0.01 * total
    whole = mixing.mixed(frame)
    assert whole.columns == frame.columns
    assert sum(len(r["text"].split()) for r in whole.collect()) == sum(r["taken"] for r in mixing.mix(frame).collect())
    assert mixing.mix(frame.limit(0)).count() == 0 and mixing.mixed(frame.limit(0)).count() == 0


def test_targets_stop_at_three_times():
    assert mixing.targets([100, 1, 1], [1, 2, 3]) == [96.0, 3.0, 3.0]


def test_archives(spark):
    long = "<p>" + "é" * 100
    rows = [(3, "http://a/\r\nX: y", long), (1, None, long), (2, "u", "short"), (4, "u", "short"), (5, "u", None), (None, "u", long), (1, "again", long)]
    found = warc.round_trip(spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, payload string")).collect()
    assert len(found) == len(rows)
    kinds = sorted(((r["page_id"], r["record_type"], r["refers_to"]) for r in found), key=repr)
    assert kinds == sorted([(3, "revisit", 1), (1, "response", None), (2, "response", None), (4, "response", None), (5, "response", None), (None, "revisit", 1), (1, "response", None)], key=repr)
    raw = long.encode()
    assert all((r["payload_bytes"], r["payload_digest"]) == (len(raw), hashlib.sha256(raw).hexdigest()) for r in found if r["page_id"] in (1, 3, None))
    good = warc.page_record(1, "u", raw, hashlib.sha256(raw).hexdigest(), None, False)
    assert [warc.parse(m).headers["warc-type"] for m in warc.members(good + good, 7)] == ["response"] * 2
    plain = zlib.decompress(good, 31)
    for bad in (plain.replace(b"Content-Length: 2", b"Content-Length: 3"), plain.replace("é".encode(), b"ee", 1)):
        with pytest.raises(ValueError):
            warc.parse(bad)
    with pytest.raises(ValueError):
        list(warc.members(good[:-3]))
    assert warc.round_trip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


@given(st.lists(st.binary(max_size=900), max_size=4))
@settings(max_examples=60, deadline=None)
def test_media_round_trip(raws):
    stored = media.encode_all(raws)
    assert stored == [media.encode(raw) for raw in raws]
    for raw, images in zip(raws, media.decode_all(stored)):
        assert media.payload_of(images) == media.padded(raw)
        assert (images[0].thumbnail.reshape(-1) == np.frombuffer(media.padded(raw), np.uint8)[::64]).all()


def plain_levels(data):
    """Coefficients of a grey or two-component baseline JPEG, read bit by bit; of the first component, in the order of the scan."""
    at, tables, restart, factors = 2, {}, 0, {}
    while True:
        marker, size = data[at + 1], int.from_bytes(data[at + 2 : at + 4], "big")
        body, at = data[at + 4 : at + 2 + size], at + 2 + size
        if marker == 0xC4:
            while body:
                kind, counts, code = body[0], body[1:17], 0
                symbols, own = list(body[17 : 17 + sum(counts)]), {}
                for n, count in enumerate(counts, 1):
                    for _ in range(count):
                        own[f"{code:0{n}b}"] = symbols.pop(0)
                        code += 1
                    code <<= 1
                tables[kind], body = own, body[17 + sum(counts) :]
        elif marker == 0xDD:
            restart = int.from_bytes(body, "big")
        elif marker == 0xC0:
            height, width = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big")
            factors = {body[6 + 3 * i]: body[7 + 3 * i] for i in range(body[5])}
        elif marker == 0xDA:
            chosen = [(body[1 + 2 * i], body[2 + 2 * i]) for i in range(body[0])]
            break
    parts = re.split(rb"\xff[\xd0-\xd7]", data[at : data.rindex(b"\xff\xd9")])
    many = len(chosen) > 1
    h, v = max(f >> 4 for f in factors.values()) if many else 1, max(f & 15 for f in factors.values()) if many else 1
    total, out = -(-width // (8 * h)) * -(-height // (8 * v)), []
    for part in parts:
        bits = "".join(f"{b:08b}" for b in part.replace(b"\xff\0", b"\xff"))
        before, p = collections.Counter(), 0

        def symbol(table):
            nonlocal p
            n = next(n for n in range(1, 17) if bits[p : p + n] in table)
            p += n
            return table[bits[p - n : p]]

        def number(size):
            nonlocal p
            p += size
            raw = int(bits[p - size : p] or "0", 2)
            return raw if not size or raw >> size - 1 else raw - (1 << size) + 1

        for _ in range(min(restart or total, total)):
            total -= 1
            for name, which in chosen:
                for _ in range((factors[name] >> 4) * (factors[name] & 15) if many else 1):
                    before[name] += number(symbol(tables[which >> 4]))
                    block, k = [before[name]] + [0] * 63, 1
                    while k < 64:
                        s = symbol(tables[16 + (which & 15)])
                        if s == 0:
                            break
                        k += s >> 4
                        block[k] = number(s & 15)
                        k += 1
                    if name == chosen[0][0]:
                        out.append(block)
    return out


def test_media_by_a_plain_decoder(spark):
    rnd = random.Random(3)
    for raw in (b"", bytes(range(256)) * 4, b"\xff" * 500, bytes(rnd.choices(b"etaoin shr", k=700))):
        stored = media.encode(raw)
        plain = plain_levels(stored)
        assert (media.decode(stored).levels == np.array(plain)).all()
        assert bytes((x if x > 0 else x + 255) if i else x + 128 for block in plain for i, x in enumerate(block)) == media.padded(raw)


def written(width, height, factors, restart, rnd):
    """A baseline JPEG of random coefficients with runs and early ends, each component with its own tables."""
    symbols = [0x00, 0x03, 0x12, 0x31, 0xF0, 0x05, 0x42]
    code = {s: f"{i:03b}" for i, s in enumerate(symbols)}
    dc = {s: f"{s:04b}" for s in range(11)}
    table = lambda kind, own, n: media._segment(0xC4, bytes([kind]) + bytes(len(own) if i == n else 0 for i in range(1, 17)) + bytes(own))
    value = lambda size: "".join(rnd.choice("01") for _ in range(size))
    many = len(factors) > 1
    h, v = max(f >> 4 for f in factors) if many else 1, max(f & 15 for f in factors) if many else 1
    total, scan = -(-width // (8 * h)) * -(-height // (8 * v)), b""
    for start in range(0, total, restart or total):
        bits = ""
        for _ in range(start, min(total, start + (restart or total))):
            for f in factors:
                for _ in range((f >> 4) * (f & 15) if many else 1):
                    size = rnd.randint(0, 4)
                    bits += dc[size] + value(size)
                    k = 1
                    while k < 64:
                        s = rnd.choice([x for x in symbols if k + (x >> 4) <= 63])
                        bits += code[s]
                        if s == 0:
                            break
                        bits += value(s & 15)
                        k += (s >> 4) + 1
        bits += "1" * (-len(bits) % 8)
        scan += int(bits, 2).to_bytes(len(bits) // 8, "big").replace(b"\xff", b"\xff\0") + bytes([0xFF, 0xD0 + start // (restart or total) % 8])
    frame = media._segment(0xC0, bytes([8]) + height.to_bytes(2, "big") + width.to_bytes(2, "big") + bytes([len(factors)]) + b"".join(bytes([i + 1, f, 0]) for i, f in enumerate(factors)))
    tables = table(0, list(dc), 4) + table(0x10, symbols, 3)
    head = media._segment(0xDA, bytes([len(factors)]) + b"".join(bytes([i + 1, 0]) for i in range(len(factors))) + bytes([0, 63, 0]))
    between = media._segment(0xDD, restart.to_bytes(2, "big")) if restart else b""
    return b"\xff\xd8" + media._segment(0xDB, bytes([0]) + bytes([3] * 64)) + frame + tables + between + head + scan[:-2] + b"\xff\xd9"


@pytest.mark.parametrize(("factors", "restart"), [([0x11], 0), ([0x22], 4), ([0x11, 0x11], 3), ([0x22, 0x11], 0), ([0x21, 0x12], 2)])
def test_general_images_by_a_plain_decoder(factors, restart):
    rnd = random.Random(len(factors) * 10 + restart)
    stored = [written(rnd.randint(1, 70), rnd.randint(1, 50), factors, restart, rnd) for _ in range(4)]
    for data, (image,) in zip(stored, media.decode_all(stored)):
        plain, (h, v) = plain_levels(data), (factors[0] >> 4, factors[0] & 15) if len(factors) > 1 else (1, 1)
        wide = -(-image.width // (8 * max(f >> 4 for f in factors))) if len(factors) > 1 else image.thumbnail.shape[1]
        place = {}
        for i, block in enumerate(plain):
            unit, part = divmod(i, h * v)
            place[unit // wide * v + part // h, unit % wide * h + part % h] = block
        down, across = image.thumbnail.shape
        assert image.levels.tolist() == [place[y, x] for y in range(down) for x in range(across)]
        assert (image.thumbnail.reshape(-1) == np.clip(np.rint(image.levels[:, 0] * 3 / 8 + 128), 0, 255)).all()


def test_media_rows(spark, monkeypatch):
    stored = media.encode(bytes(range(256)) * 6)
    for bad in (stored[: len(stored) // 2], b"", stored[2:]):
        with pytest.raises((ValueError, IndexError)):
            media.decode(bad)
    texts = [None, "", "é" * 5000, "é" * 5000, "x" * 400_000]
    rows = spark.createDataFrame([(None if i == 1 else i, t, 1, b"x") for i, t in enumerate(texts)], "doc_id long, text string, n_bytes int, media binary")
    found = {r["doc_id"]: r for r in media.described(media.media_column(rows)).collect()}
    for i, text in enumerate(texts):
        r, raw = found[None if i == 1 else i], (text or "").encode()
        payload = raw + b" " * (-len(raw) % 192 if raw else 192)
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        means = np.frombuffer(payload, np.uint8)[::64].reshape(-1, 3).astype(float)
        cells = [means[[y for y in range(len(means)) if y * 8 // len(means) == i]][:, [x for x in range(3) if x * 8 // 3 == j]] for i in range(8) for j in range(8)]
        bright = "".join(str(int(c.size > 0 and c.sum() > means.mean() * c.size)) for c in cells)
        assert r["feature"] == f"3x{len(means)}:{int(bright, 2):016x}" and r["media_sha256"] == hashlib.sha256(media.encode(raw)).hexdigest()
    assert tuple(found[2])[1:] == tuple(found[3])[1:]
    assert media.described(media.media_column(rows.limit(0))).count() == 0
    monkeypatch.setattr(media, "IMAGE_ROWS", 2)
    many = media.encode(b"abc" * 400)
    assert many.count(b"\xff\xd8\xff") == 4 and media.payload_of(media.decode_all([many])[0]) == media.padded(b"abc" * 400)


PAGE = '<html><head><title>T</title><script>var a="<p>x</p>";</script></head><body><nav><a href=/>Menu</a></nav><div class="cookie-notice">We use cookies</div><div class="post-{n}"><h1>Head{n}</h1><p>One <b>two</b>&amp;&eacute;\n three<br>four<p>Five &lt;six&gt; {long}<form><input value=x>send</form></div><div class="comments"><p>{reply}</p></div><aside>side</aside><footer>foot</footer></body></html>'


def test_page_text(spark):
    rows = [(n, "http://www.Host.org:80/a", PAGE.format(n=n, long="seven " * 20, reply="nice " * (200 if n == 3 else 2))) for n in range(6)] + [(10, None, None), (11, "odd", "plain  text"), (12, "http://host.org/x", "<p>a<p>b")]
    found = {r["page_id"]: r for r in htmltext.main_text(spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, text int")).collect()}
    for n in range(6):
        assert found[n]["text"] == f"Head{n} One two&é three four Five <six> " + " ".join(["seven"] * 20)
    assert found[10]["text"] == "" and found[11]["text"] == "plain text" and found[12]["text"] == "a b" and found[12]["n_chars"] == 3
    assert htmltext.main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


LEAD, REST = "lead " * 35, "rest " * 65


@pytest.mark.parametrize(
    "body",
    [
        f"<main><h1>Head</h1><p>{LEAD}</p><section>{REST}</section></main>",
        f"<div><h1>Head</h1><p>{LEAD}</p><blockquote>{REST}</blockquote></div>",
        f"<div><h1>Head</h1><p>{LEAD}</p><table><tr><td>{REST}</td></tr></table></div>",
        f"<nav>Menu</nav><div><article><h1>Head</h1><p>{LEAD}</p></article><article>{REST}</article></div>",
        f"<main><h1><a href=/>Head</a></h1><p>{LEAD}</p><article>{REST}</article></main>",
    ],
)
def test_nothing_but_boilerplate_goes(body):
    page = f"<html><body><nav><a href=/>Menu</a></nav>{body}<footer>foot</footer></body></html>"
    assert htmltext.extract(page, htmltext.vote(page)).split() == ["Head", *LEAD.split(), *REST.split()]


def test_page_unlike_its_host(spark):
    most = "<html><body><div><p>{0}</p></div></body></html>"
    other = f"<html><body><section><div>tag</div></section><div>box</div><article><p>{LEAD}</p></article></body></html>"
    for url in ("http://a.org/x", None):
        rows = [(n, url, most.format(REST)) for n in range(3)] + [(9, url, other)]
        found = {r["page_id"]: r["text"] for r in htmltext.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
        assert found == {0: REST.strip(), 1: REST.strip(), 2: REST.strip(), 9: LEAD.strip()}


@pytest.mark.parametrize(
    "source",
    ["<a " * 350_000, "<div>" * 200_000, "<b>" * 330_000, "<p><button>" + "<b>" * 90_000 + "<hr>" * 90_000, "<i><div>" + "<b>" * 90_000 + "</i>" * 90_000, "<a \"'" * 200_000, "<!" * 500_000, "<ul><li>" * 110_000, "<main>x" * 130_000],
)
def test_time_grows_with_the_page_alone(source):
    began = time.process_time()
    htmltext.vote(source)
    assert time.process_time() - began < 12  # seconds for a megabyte; time with the square of it would be hours


def test_forms():
    prose = "word " * 60
    whole = f"<html><body><form id=aspnet><article><p>{prose}</p></article><input value=x><select><option>a</select></form><footer>f</footer></body></html>"
    assert htmltext.extract(whole, None) == prose.strip()
    assert htmltext.extract(f"<body><p>{prose}</p><form><p>Your name</p><label>Mail</label><input></form></body>", None) == prose.strip()
    assert htmltext.extract("<body><form><label>User</label><input></form>x</body>", None) == "x"


def test_paths_are_told_apart_by_all_their_classes(spark):
    deep = "<div>" * 60
    most = f"<html><body>{deep}<div class='a b c d'><p>{{0}}</p></div></body></html>"
    other = f"<html><body>{deep}<div class='a b c e'><p>box</p></div><div class='x'><p>{LEAD}</p></div></body></html>"
    assert htmltext.vote(most.format(REST)) != htmltext.vote(most.format(REST).replace("a b c d", "a b c e"))
    rows = [(n, "http://a.org/x", most.format(REST)) for n in range(3)] + [(9, "http://a.org/x", other)] * 2
    found = sorted((r["page_id"], r["text"]) for r in htmltext.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect())
    assert found == [(n, REST.strip()) for n in range(3)] + [(9, f"box {LEAD.strip()}")] * 2


class Plain(html.parser.HTMLParser):
    """A plain extractor of well-formed pages: blocks of the one article, without what the page's own labels call boilerplate."""

    def __init__(self):
        super().__init__()
        self.stack, self.blocks = [], [""]

    def handle_starttag(self, tag, attrs):
        if tag not in ("br", "input", "img"):
            self.stack.append((tag, dict(attrs).get("class", "")))
        if tag not in ("b", "i", "a", "span"):
            self.blocks.append("")

    def handle_endtag(self, tag):
        self.stack.pop()
        if tag not in ("b", "i", "a", "span"):
            self.blocks.append("")

    def handle_data(self, data):
        if any(t == "article" for t, _ in self.stack) and not any(t in ("script", "aside", "form", "nav") or c in ("comments", "share") for t, c in self.stack):
            self.blocks[-1] += data


def test_page_text_by_a_plain_extractor(spark):
    rnd = random.Random(9)

    def text():
        return " ".join(rnd.choice(["one", "two &amp; three", "f&uuml;r", "<b>bold</b>", "<a href='/x'>link</a>", "x &lt; y", "\n tab\t"]) for _ in range(rnd.randint(3, 30)))

    rows = []
    for i in range(60):
        parts = [f"<h1>{text()}</h1>"] + [rnd.choice([f"<p>{text()}</p>", f"<ul><li>{text()}</li><li>{text()}</li></ul>", f"<section><h2>{text()}</h2><p>{text()}</p></section>", "<aside><p>see</p></aside>", "<div class='share'>share</div>", "<script>if (a < b) {}</script>"]) for _ in range(rnd.randint(2, 9))]
        page = f"<html><head><title>t</title></head><body><header>top</header><nav><a href='/'>Menu</a></nav><div class='wrap'><article>{''.join(parts)}<p>{text()} end</p></article><div class='comments'><p>{text()}</p></div></div><footer>foot</footer></body></html>"
        rows.append((i, f"http://h{i % 3}.org/{i}", page))
    found = {r["page_id"]: r["text"] for r in htmltext.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i, _, page in rows:
        plain = Plain()
        plain.feed(page)
        assert found[i] == " ".join(" ".join(" ".join(b.split()) for b in plain.blocks).split())


def test_search_recall_and_order(spark):
    rng = np.random.RandomState(1)
    centres = rng.normal(size=(10, 16))
    vectors = (centres[rng.randint(0, 10, 1500)] + rng.normal(size=(1500, 16)) * 0.5).astype(np.float32)
    vectors[200:260] = vectors[100]
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    odd = [(5000, None), (5100, []), (5200, [0.0] * 16), (5300, [float("nan")] * 16), (None, [1.0] * 16), (5400, [1.0, None] + [1.0] * 14), (5500, [1.0] * 3), (7, rows[7][1])]
    found = ann.search(spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>")).collect()
    wide = vectors.astype(float)
    hits = total = 0
    by = collections.defaultdict(list)
    for r in sorted(found, key=lambda r: (r["query_id"], r["rank"])):
        by[r["query_id"]].append(r)
        assert abs(r["score"] - np.sqrt(((wide[r["query_id"]] - wide[r["vec_id"]]) ** 2).sum())) < 1e-9
    assert sorted(by) == list(range(0, 1500, 100))
    for q, rs in by.items():
        assert [r["rank"] for r in rs] == list(range(1, 11)) and [(r["score"], r["vec_id"]) for r in rs] == sorted((r["score"], r["vec_id"]) for r in rs)
        far = np.sqrt(((wide - wide[q]) ** 2).sum(axis=1))
        best = [i for i in np.lexsort((np.arange(1500), far)) if i != q][:10]
        hits += len({r["vec_id"] for r in rs} & set(best))
        total += 10
    assert hits >= 0.9 * total
    assert [r["vec_id"] for r in by[100]] == list(range(200, 210))
    few = ann.search(spark.createDataFrame(rows[:4], "vec_id long, embedding array<float>")).collect()
    assert [(r["query_id"], r["rank"]) for r in few] == [(0, 1), (0, 2), (0, 3)]
    assert ann.search(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_search_within_near_copies(spark):
    rng = np.random.RandomState(3)
    vectors = rng.normal(size=(3000, 64))
    for at in (0, 1000):
        vectors[at : at + 400] = vectors[at] + rng.normal(size=(400, 64)) * 1e-4
    vectors = vectors[rng.permutation(3000)].astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    wide = vectors.astype(float)
    by = collections.defaultdict(list)
    for r in sorted(ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), every=20).collect(), key=lambda r: (r["query_id"], r["rank"])):
        by[r["query_id"]].append(r["vec_id"])
    inside = 0
    for q, got in by.items():
        far = np.sqrt(((wide - wide[q]) ** 2).sum(axis=1))
        best = [i for i in np.lexsort((np.arange(3000), far)) if i != q][:10]
        if far[best[-1]] < 0.01:
            inside += 1
            assert got == best
    assert inside >= 20


def test_words_are_counted_as_said(spark):
    texts = [None, "", " ", "a", " a\tb\x0bc ", "a\xa0b\x1cc d", "\n\n", "\x85\u2003x", "w " * 400_000]
    found = mixing.counted(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "doc_id", "text", "size", "key").orderBy("doc_id").collect()
    assert [r["size"] for r in found] == [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for t in texts]


@pytest.mark.parametrize(("blocks", "shard_words", "shard_rows", "group_shards"), [(13, 100, 1 << 18, 1 << 12), (1, 500, 1 << 18, 4), (1 << 20, 50_000, 20, 3), (100, 3000, 1 << 18, 1 << 12)])
def test_mix_comes_near_its_targets_at_any_ratio(spark, blocks, shard_words, shard_rows, group_shards):
    """Also where a block would be larger than a shard, as it would be in a large corpus, and where most ids are null or repeat."""
    rnd = random.Random(7)
    rows = [(rnd.choice([None, 7, i]), " ".join([f"w{i}"] * rnd.randint(1, 30)), ["a", "a", "a", "b", None][i % 5] if i > 40 else "0", f"{i}") for i in range(2000)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string, size string")
    options = {"blocks": blocks, "shard_words": shard_words, "shard_rows": shard_rows, "group_shards": group_shards}
    found = mixing.mix(frame, **options).collect()
    assert sorted(map(tuple, found), key=repr) == sorted(map(tuple, mixing.mix(frame.repartition(5), **options).collect()), key=repr)
    by = collections.defaultdict(list)
    for r in found:
        assert 0 <= r["taken"] <= 3 * r["size"]
        by[r["source"]].append(r)
    assert sum(r["size"] for r in found) == sum(len(t.split()) for _, t, _, _ in rows)
    names = ["0", "a", "b", None]
    want = mixing.targets([sum(r["size"] for r in by[n]) for n in names], [1, 2, 3, 1])
    for n, target in zip(names, want):
        assert abs(by[n][0]["target"] - target) < 1e-6
        assert abs(sum(r["taken"] for r in by[n]) - target) <= 0.01 * target + 1


@given(st.lists(st.integers(0, 300), min_size=1, max_size=8), st.integers(0, 200), st.data())
@settings(max_examples=60, deadline=None)
def test_sainte_lague_with_a_most(votes, seats, data):
    most = [data.draw(st.integers(0, 60)) for _ in votes]
    plain = [0] * len(votes)
    for _ in range(seats):
        open_ = [i for i in range(len(votes)) if votes[i] and plain[i] < most[i]]
        if open_:
            plain[max(open_, key=lambda i: (votes[i] / (2 * plain[i] + 1), -i))] += 1
    assert mixing.sainte_lague([float(v) for v in votes], seats, most) == plain
