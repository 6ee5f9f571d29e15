import base64

import pytest

from codeloom.llm import sentences as S


def units(text):
    return [text[a:b] for a, b in S.split_text(text)]


CASES = [
    ("One here. Two there! Three?", ["One here.", "Two there!", "Three?"]),
    ("Some tools, e.g. the willow, stitch it. See sec. 3 and Fig. 4 for it.", ["Some tools, e.g. the willow, stitch it.", "See sec. 3 and Fig. 4 for it."]),
    ("It was dense until 5 p.m. Once it ran at 9 a.m. on a node.", ["It was dense until 5 p.m.", "Once it ran at 9 a.m. on a node."]),
    ("It holds tags, rows, etc. Use it. We tried tag, etc. and stopped.", ["It holds tags, rows, etc.", "Use it.", "We tried tag, etc. and stopped."]),
    ("No. 3 is closed, no. 4 is not. No. It is.", ["No. 3 is closed, no. 4 is not.", "No.", "It is."]),
    ("Inc. one and Ltd. two are names. Mr. Robot ran.", ["Inc. one and Ltd. two are names.", "Mr. Robot ran."]),
    ("The ratio rose from 0.145 to 37.6. The v1.2.3 is out.", ["The ratio rose from 0.145 to 37.6.", "The v1.2.3 is out."]),
    ('"It fails. Always," the report said. It printed "Done. Bye!" and stopped.', ['"It fails. Always," the report said.', 'It printed "Done. Bye!" and stopped.']),
    ('The log ends with "cannot go." Then it stops. (Not covered here.) Next.', ['The log ends with "cannot go."', "Then it stops.", "(Not covered here.)", "Next."]),
    ("The quota... well, it is cold. Is it partial?! What is it...? It is.", ["The quota... well, it is cold.", "Is it partial?!", "What is it...?", "It is."]),
    ("It ends. shrink_copper returns null. The rest. `code` here.", ["It ends.", "shrink_copper returns null.", "The rest.", "`code` here."]),
    ("The cache (why?) is hot. Open https://a.b/c.d/v1.2/index.html for it.", ["The cache (why?) is hot.", "Open https://a.b/c.d/v1.2/index.html for it."]),
    ("Er fragte: „Wo ist er?“ Siehe Abs. 7, d. h. den Teil. Am 3. März war es. Ab dem 1. Lauf z. B. auch.", ["Er fragte: „Wo ist er?“", "Siehe Abs. 7, d. h. den Teil.", "Am 3. März war es.", "Ab dem 1. Lauf z. B. auch."]),
    ("Im Bericht steht „Er fehlt. Bitte warten.“ und nichts. Ende.", ["Im Bericht steht „Er fehlt. Bitte warten.“ und nichts.", "Ende."]),
    ("Le bloc affiche « prêt ? » ici. M. le cache ne répond plus ! Le journal dit « Non. Pas. » puis non. L'art. 2 va.", ["Le bloc affiche « prêt ? » ici.", "M. le cache ne répond plus !", "Le journal dit « Non. Pas. » puis non.", "L'art. 2 va."]),
    ("El Sr. nodo, p. ej., usa la pág. 3. ¿Por qué queda vacío? ¡No borre! Fin.", ["El Sr. nodo, p. ej., usa la pág. 3.", "¿Por qué queda vacío?", "¡No borre!", "Fin."]),
    ("См. рис. 7 и т. д. в описании. Это т. е. графа нет. Размер — ок. 110 тыс. строк, см. п. 8 тут.", ["См. рис. 7 и т. д. в описании.", "Это т. е. графа нет.", "Размер — ок. 110 тыс. строк, см. п. 8 тут."]),
    ("报告说：“缺少日志。”“队列坏了！”他写道，然后重建了队列。比例从8.22升到83。", ["报告说：“缺少日志。”", "“队列坏了！”他写道，然后重建了队列。", "比例从8.22升到83。"]),
    ("報告書には「履歴がない。」とある。なぜ空ですか？v1.2.3で直した。", ["報告書には「履歴がない。」とある。", "なぜ空ですか？", "v1.2.3で直した。"]),
    ("ทำไมคิวจึงว่างเปล่า รุ่น v8.1.1 แก้ปัญหาแล้ว  ระบบโหลดใหม่หลังจาก 375 วินาที", ["ทำไมคิวจึงว่างเปล่า", "รุ่น v8.1.1 แก้ปัญหาแล้ว", "ระบบโหลดใหม่หลังจาก 375 วินาที"]),
    ("لماذا يبقى الفهرس فارغا؟ ارتفعت النسبة من 9.20 إلى 911. افحص الفرع!", ["لماذا يبقى الفهرس فارغا؟", "ارتفعت النسبة من 9.20 إلى 911.", "افحص الفرع!"]),
    ("अनुपात 3.38 से 444 तक बढ़ा। कतार खाली क्यों है? कैश है!", ["अनुपात 3.38 से 444 तक बढ़ा।", "कतार खाली क्यों है?", "कैश है!"]),
    ("# Title. With stop\nText one.\nText two\ngoes on.\n\nno stop\n\nEnd", ["# Title. With stop", "Text one.", "Text two\ngoes on.", "no stop", "End"]),
    ("1. One. Two.\n2. Three\n\n- a. b. c\n- d", ["1. One. Two.", "2. Three", "- a. b. c", "- d"]),
    ("Intro:\n```py\nx. Y. Z\n\n# no heading\n```\nAfter. End.", ["Intro:", "```py\nx. Y. Z\n\n# no heading\n```", "After.", "End."]),
    ("Open.\n```\nnever closed. Here\n\n", ["Open.", "```\nnever closed. Here"]),
    ("Ab dem\n3. März geht es. Ende.", ["Ab dem\n3. März geht es.", "Ende."]),
    ("  padded.   Next.  ", ["padded.", "Next."]),
]


@pytest.mark.parametrize("text,wanted", CASES)
def test_units(text, wanted):
    assert units(text) == wanted


def test_empty_and_odd_texts():
    for text in (None, "", "  \n\t", "\n\n"):
        assert S.split_text(text) == []
    assert units("...") == ["..."] and units("?!") == ["?!"]
    assert units('"never closed. Two here.') == ['"never closed.', "Two here."]
    assert len(S.split_text("A sentence is here. " * 20_000)) == 20_000
    assert S.split_text("x" * 500_000) == [(0, 500_000)]


def test_units_cover_the_text():
    for text, _ in CASES:
        at = 0
        for a, b in S.split_text(text):
            assert not text[at:a].strip() and a < b and not text[b - 1].isspace() and not text[a].isspace()
            at = b
        assert not text[at:].strip()


def test_lattice_prefers_dictionary_words():
    assert S.word_lattice("他写道然后") == ("他写道", "然后")
    assert S.word_lattice("") == ()


def _lexicon(path, *lines):
    path.write_bytes(b"".join(line + b"\n" for line in lines))
    return str(path)


def _line(word, rank):
    return base64.b64encode(word) + b" %d" % rank


def test_a_missing_or_damaged_vocabulary_is_an_error(tmp_path):
    good = _line("索引".encode(), 0)
    with pytest.raises(FileNotFoundError):
        S.dictionary(str(tmp_path / "none"), S._FINALS)
    for k, damaged in enumerate([good[:-2], b"*** 1", good[:-3] + b" 1", good + b" 7", good + b"x"]):
        path = _lexicon(tmp_path / f"damaged{k}", good, damaged)
        with pytest.raises(ValueError, match=f"damaged{k}, line 2"):
            S.dictionary(path, S._FINALS)
    for k, lines in enumerate([[], [b""], [_line(b"ab", 0)]]):
        with pytest.raises(ValueError, match="no words"):
            S.dictionary(_lexicon(tmp_path / f"empty{k}", *lines), S._FINALS)


def test_a_vocabulary_has_parts_of_characters_that_are_no_words(tmp_path):
    path = _lexicon(tmp_path / "good", _line(b"\xe7\xb4", 0), _line("索".encode(), 1), b"", _line("索引".encode(), 2), _line(b"ab", 3))
    assert S.dictionary(path, frozenset(["的"])) == ({"索引": 1.2, "的": 1.0}, 2)


def test_a_missing_vocabulary_gives_no_units(monkeypatch, tmp_path):
    """The words of the file decide here: an opening word is cut off only where no longer word holds it."""
    text = "你好吗这个索引很慢。"
    assert units(text) == [text]
    S.word_lattice.cache_clear()
    monkeypatch.setattr(S, "LEXICON", str(tmp_path / "none"))
    for _ in range(2):
        with pytest.raises(FileNotFoundError):
            units(text)
    assert units("No spaceless run. No dictionary.") == ["No spaceless run.", "No dictionary."]


UNMARKED = "今天天气很好吗我们去公园吧然后回家。"


def test_particles_and_openers_end_sentences_without_terminators():
    assert units(UNMARKED) == ["今天天气很好吗", "我们去公园吧", "然后回家。"]
    assert units("ペンですしかし高いですか？はい。") == ["ペンです", "しかし高いですか？", "はい。"]
    assert units("“你好吗我们走”他说。") == ["“你好吗我们走”他说。"]
    assert units("これはペンですか？") == ["これはペンですか？"]


@pytest.mark.parametrize("words", ["_FINALS", "_OPENERS"])
def test_finals_and_openers_decide(monkeypatch, words):
    monkeypatch.setattr(S, words, frozenset())
    assert units(UNMARKED) == [UNMARKED]


def test_carried_on_after_a_quotation():
    assert units("“索引坏了！”他写道，然后走了。“好。”节点重启。") == ["“索引坏了！”他写道，然后走了。", "“好。”", "节点重启。"]
    assert units("報告書には「ない。」とある。次です。") == ["報告書には「ない。」とある。", "次です。"]


def test_terminators_of_khmer_and_burmese():
    assert units("ខ្ញុំទៅ។អ្នកមក។") == ["ខ្ញុំទៅ។", "អ្នកមក។"]
    assert units("သွားမယ်။လာမယ်။") == ["သွားမယ်။", "လာမယ်။"]


def _brute(text, gaps, whole):
    best = (0.0, [])
    for mask in range(1 << len(gaps)):
        chosen = [g for k, g in enumerate(gaps) if mask >> k & 1]
        ends = [0, *[at for at, _ in chosen], whole]
        if all(any(c.isalnum() for c in text[a:b]) for a, b in zip(ends, ends[1:], strict=False)):
            best = min(best, (sum(c for _, c in chosen), [at for at, _ in chosen]))
    return [*best[1], whole]


@pytest.mark.parametrize("text", ["a. b. c.", "a.. .b", "... a . . b", "a b", ".a."])
def test_the_path_is_the_cheapest(text):
    costs = [-1.0, 0.5, -0.25, -0.75]
    gaps = [(k + 1, costs[k % 4]) for k, c in enumerate(text[:-1]) if c == "."]
    found = S._cheapest_path(text, gaps, len(text))
    total = dict(gaps)
    assert sum(total[e] for e in found[:-1]) == sum(total[e] for e in _brute(text, gaps, len(text))[:-1])


def test_deep_quotations_and_long_words_have_no_bound():
    deep = "(" * 200 + "A b. C d" + ")" * 200 + ". Next one."
    assert units(deep)[-1] == "Next one." and len(units(deep)) == 2
    assert units("x" * 300 + "etc. of it. Done.") == ["x" * 300 + "etc. of it.", "Done."]


def test_tables(spark):
    rows = [(1, "A b. C d.", "u"), (1, "A b. C d.", "u"), (2, None, None), (None, "X. Y.", None), (3, "😀 one. Two.", None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, units string")
    got = sorted(map(tuple, S.boundaries(frame).select("doc_id", "sent_end").distinct().collect()))
    assert got == [(1, 4), (1, 9), (3, 6), (3, 11)]
    assert sorted((r["doc_id"], r["sentence"]) for r in S.sentences(frame).collect()) == [(1, "A b."), (1, "C d."), (3, "Two."), (3, "😀 one.")]
    assert S.boundaries(frame.limit(0)).count() == 0
    assert S.segment(frame.drop("units")).count() == 5
