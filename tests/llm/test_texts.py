import random

import pytest
from pyspark.sql import functions as F

from strandline.llm.leakage import PassageSearch, find_leaks
from strandline.llm.packing import pack_documents, pack_histogram
from strandline.llm.splitting import split_documents, split_text
from strandline.llm.text import words
from strandline.llm.tokens import TOKENIZER, tokenizer


@pytest.mark.parametrize("seed", range(5))
def test_histogram_packing_places_each_item_once(seed):
    r = random.Random(seed)
    cap = r.choice([10, 100, 512])
    hist = {r.randint(1, cap): r.randint(1, 50) for _ in range(r.randint(1, 60))}
    placed = {}
    packs = pack_histogram(hist, cap)
    for n, pattern in packs:
        assert n > 0 and sum(k * t for k, t in pattern) <= cap
        for k, t in pattern:
            placed[k] = placed.get(k, 0) + n * t
    assert placed == hist
    # two packs at most half full would have been one
    assert sum(n for n, p in packs if sum(k * t for k, t in p) * 2 <= cap) <= 1


def test_packing_fills_well():
    r = random.Random(1)
    hist = {}
    for _ in range(20000):
        k = min(2048, int(r.lognormvariate(5.5, 1)) + 1)
        hist[k] = hist.get(k, 0) + 1
    packs = pack_histogram(hist, 2048)
    assert sum(k * n for k, n in hist.items()) / (2048 * sum(n for n, _ in packs)) > 0.99


def check_pack(spark, texts, capacity):
    df = spark.createDataFrame(list(enumerate(texts)), "id bigint, text string").withColumn("piece", F.lit("clash")).repartition(4)
    got = pack_documents(df, doc_id="id", text="text", capacity=capacity).collect()
    count = tokenizer(TOKENIZER).count
    by_doc, by_box = {}, {}
    for x in got:
        by_doc.setdefault(x.id, []).append((x.piece, x.start_token, x.n_tokens))
        if x.n_tokens:
            by_box.setdefault(x.container_id, []).append((x.container_offset, x.n_tokens))
    for i, t in enumerate(texts):
        if t is None:
            assert i not in by_doc
            continue
        pieces, n = sorted(by_doc[i]), count(t)
        assert [p[0] for p in pieces] == list(range(len(pieces))) and sum(p[2] for p in pieces) == n
        assert len(pieces) == max(1, -(-n // capacity)) and all(p[1] == k * capacity for k, p in enumerate(pieces))
    for spans in by_box.values():
        at = 0
        for offset, n in sorted(spans):
            assert offset == at
            at += n
        assert at <= capacity


def test_pack_documents(spark):
    r = random.Random(3)
    texts = [None, "", "one"] + [" ".join(r.choice(["alpha", "bé", "中文", "x"]) for _ in range(r.choice([3, 3, 3, 9, 40, 200]))) for _ in range(200)] + ["same text here"] * 120
    check_pack(spark, texts, 64)
    check_pack(spark, [], 64)
    check_pack(spark, [None, ""], 64)


ITEM = "When Limymilow opened reel 469, archivist Hovebomond counted 123 torn perforations beside marker Iskethlow and noted tint Coreboholm."


def test_leak_variants(spark):
    hidden = [
        ITEM.upper(),
        "so: " + ITEM[:90].replace(" ", " \n> ") + " and",
        ITEM.replace("archivist", "archi-\nvist").replace("e", "é"),
        "<p>" + "".join(chr(ord(c) + 0xFEE0) if "!" <= c <= "~" else c for c in ITEM) + "</p>",
        ITEM.replace(" ", "_").replace("torn", "to­rn"),
    ]
    clean = [None, "", ITEM.replace("counted", "saw"), " ".join(ITEM.split()[:11]), "nothing"]
    docs = spark.createDataFrame(list(enumerate(hidden + clean)), "doc_id bigint, text string").withColumn("item_id", F.lit("clash"))
    items = spark.createDataFrame([(1, ITEM), (2, ITEM + " Then more words follow."), (3, "too short"), (4, None), (5, "")], "item_id bigint, text string")
    for block in (8_000_000, 60):
        got = {tuple(x) for x in find_leaks(docs, items, doc_id="doc_id", doc_text="text", item_id="item_id", item_text="text", block_chars=block).collect()}
        assert got == {(i, d) for d in range(len(hidden)) for i in (1, 2)}
    assert find_leaks(docs, items.limit(0), doc_id="doc_id", doc_text="text", item_id="item_id", item_text="text").collect() == []


def test_short_items_are_found_as_a_whole(spark):
    ten = "the quick brown fox jumps over one very lazy dog"
    docs = spark.createDataFrame([(1, f"so {ten.upper()}, he said"), (2, ten.replace("lazy", "tired")), (3, "fox jumps"), (4, "")], "doc_id bigint, text string")
    items = spark.createDataFrame([(1, ten), (2, "Fox, jumps"), (3, "..."), (4, ITEM)], "item_id bigint, text string")
    got = find_leaks(docs, items, doc_id="doc_id", doc_text="text", item_id="item_id", item_text="text").collect()
    assert {tuple(x) for x in got} == {(1, 1), (2, 1), (2, 2), (2, 3)}


@pytest.mark.parametrize("seed", range(6))
def test_passage_search_against_brute_force(seed):
    r = random.Random(seed)
    least, vocab = r.choice([2, 4, 12]), "abcde"[: r.choice([2, 3, 5])]
    items = [(i, " ".join(r.choice(vocab) for _ in range(r.randint(0, 20)))) for i in range(15)]
    search = PassageSearch(items, least)
    for _ in range(60):
        text = " ".join(r.choice(vocab + "zzz"[: r.choice([0, 1])]) for _ in range(r.randint(0, 60)))
        w = words(text)
        want = set()
        for i, t in items:
            # an item of fewer words counts as a whole
            own, size = words(t), min(least, len(words(t)))
            windows = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)}
            if size and any(tuple(own[k : k + size]) in windows for k in range(len(own) - size + 1)):
                want.add(i)
        assert search.find(text) == want


@pytest.mark.parametrize("seed", range(6))
def test_split_gives_the_text_back(seed):
    r = random.Random(seed)
    bits = ["# Head\n\n", "word ", "Satz endet. ", "- item\n", "\n\n", "\r\n", "中文句子。", "x" * 300, "{\"a\": 1},", "é̂", "🎬", "  ", "\t"]
    text = "".join(r.choice(bits) for _ in range(700))
    tok = tokenizer(TOKENIZER)
    for limit, overlap in ((64, 8), (200, 50), (40, 0)):
        pieces = split_text(text, tok, limit, overlap)
        assert "".join(text[f:e] for _, f, e, _ in pieces) == text
        assert all(tok.count(text[b:e]) == n <= limit for b, _, e, n in pieces)
        assert all(b >= p[0] and f == p[2] for (b, f, _, _), p in zip(pieces[1:], pieces))
        short = [1 for (b, f, _, _), p in zip(pieces[1:], pieces) if tok.count(text[b:f]) < overlap and b > p[0]]
        assert not short


def test_split_follows_the_structure():
    tok = tokenizer(TOKENIZER)
    parts = [f"# Part {i}\n\n" + "A sentence of some words here. " * 9 + "\n\n" for i in range(4)]
    pieces = split_text("".join(parts), tok, 100, 0)
    assert ["".join(parts)[f:e] for _, f, e, _ in pieces] == parts


def test_split_documents(spark):
    rows = [(1, "word " * 500), (2, "short"), (3, None), (4, ""), (None, "word " * 500), (1, "word " * 500)]
    df = spark.createDataFrame(rows, "id bigint, text string").withColumn("piece", F.lit("clash"))
    got = split_documents(df, doc_id="id", text="text", limit=100, overlap=10).collect()
    assert {x.id for x in got} == {1} and all(x.n_tokens <= 100 for x in got)
    assert "".join(x.text[x.new_from_char - x.start_char :] for x in got) == "word " * 1000
    assert split_documents(df.limit(0), doc_id="id", text="text").collect() == []


def test_a_tag_of_any_length_is_no_word():
    from strandline.llm.text import words

    assert words("one <a href='" + "x/" * 500 + "'>two</a> three") == ["one", "two", "three"]


def pieces_of(text, limit, overlap=0):
    return [text[f:e] for _, f, e, _ in split_text(text, tokenizer(TOKENIZER), limit, overlap)]


def test_no_piece_runs_from_the_tail_of_one_section_into_the_next():
    long = "# One\n\n" + "A sentence of some words stands here. " * 260 + "\n\n"
    short = "# Two\n\n" + "Another one. " * 60
    pieces = pieces_of(long + short, 600)
    assert pieces[-1] == short and "".join(pieces) == long + short
    # whole siblings are merged
    assert pieces_of("intro words here\n\n" + long + short + "\n\n# Three\n\nend of it.", 600)[-1] == short + "\n\n# Three\n\nend of it."


def test_fences_are_whole_and_hold_no_headings():
    fence = "```\n# a comment\n" + "x = 1\n" * 30 + "```\n"
    text = "Some text before. " * 20 + "\n\n" + fence + "\n" + "Some text after. " * 20
    assert fence + "\n" in pieces_of(text, 150)
    assert not any(p.startswith("# a comment") for p in pieces_of(text, 60))
    # a fence that is never closed is text
    assert "".join(pieces_of("```\n" + "word " * 200, 50)) == "```\n" + "word " * 200


def test_headings_of_all_kinds_and_levels_are_sections():
    body = "Words of a body. " * 8 + "\n\n"
    heads = ["Top\n===\n\n", "Under\n---\n\n", "### Three\n\n", "#### Four\n\n", "##### Five\n\n", "###### Six\n\n", "<h2>Tagged</h2>\n\n"]
    parts = [h + body for h in heads]
    assert pieces_of("".join(parts), 70) == parts
    # a section goes with its subsections where they fit together
    text = "# A\n\n" + body + "## A1\n\n" + body + "# B\n\n" + body
    assert pieces_of(text, 110) == [text[: text.index("# B")], text[text.index("# B") :]]


def test_lists_nest_and_brackets_divide():
    items = ["- item %d\n" % i + "".join(f"  - sub {i}.{j} with words\n" for j in range(6)) for i in range(5)]
    assert pieces_of("".join(items), 80) == items
    import json

    text = json.dumps([{"k": i, "deep": {"a": list(range(8)), "b": "x, y"}} for i in range(12)])
    pieces = pieces_of(text, 70)
    assert "".join(pieces) == text and all(p.lstrip(" [").startswith("{") for p in pieces)
    text = "<doc>" + "".join(f"<p>Paragraph {i} has <b>some</b> words in it.</p>" for i in range(12)) + "</doc>"
    assert all(p.startswith(("<doc><p>", "<p>")) for p in pieces_of(text, 60))
