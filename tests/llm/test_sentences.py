import pytest

from proselake.llm import sentences as S

MODEL = S.Model({})


def units(text, model=MODEL):
    out, a = [], 0
    for e in S.sentence_ends(text, model):
        out.append(text[a:e].strip())
        a = e
    return out


CASES = [
    ["Dr. Fenn came at 3.30 p.m. that day.", "They left."],
    ["“It is late.", "Go home,” said Mr. Vale.", "He went."],
    ['"I saw it.', 'It was red!" Hugo cried.', "Then it rained."],
    ["“Who took it?", "Was it you?”", "The door opened."],
    ["He paused... then ran.", '"Wait...', 'No, stay," she said.'],
    ["Was it No. 2 or No. 5 in Vale St. near here?", "Yes."],
    ["(The room was empty.)", "The bill came to $2.50, about 7.5 per cent more."],
    ["„Halt!“ rief Vera und ging.", "Das kostete ca. 7,5 Mark."],
    ["«\xa0Où vas-tu\xa0?\xa0» demanda Rhys.", "Il partit."],
    ["—¿Adónde vas? —preguntó Ivy.", "¡Qué fría era!"],
    ["«Куда ты идёшь?» — спросила Вера.", "Марк ушёл."],
]


@pytest.mark.parametrize("parts", CASES)
def test_spaced_scripts(parts):
    assert units(" ".join(parts)) == parts


@pytest.mark.parametrize("parts", [
    ["秦露说：“快走！”", "“你去哪里？”林鸣问。", "何川停住了……然后卖掉了风车。"],
    ["「待って！」環世は叫び、風車を描いた。", "「どこへ行くの？」と千里が尋ねた。"],
])
def test_unspaced(parts):
    assert units("".join(parts)) == parts


def test_thai_spaces_but_not_beside_digits():
    assert units("แหราคา 7.3 บาท ดาวใสซื้อเชือก 4 อัน ทำไมภูบัวไป") == ["แหราคา 7.3 บาท", "ดาวใสซื้อเชือก 4 อัน", "ทำไมภูบัวไป"]


def test_lines_and_blank_lines():
    assert units("One line\ngoes on. Two\n\nThree without end") == ["One line\ngoes on.", "Two", "Three without end"]
    assert units("A.\r\n\r\nB is here.") == ["A.", "B is here."]


@pytest.mark.parametrize("text", [None, "", "  \n ", "\u200b"])
def test_nothing(text):
    assert S.sentence_ends(text, MODEL) in ([], [1])


def test_invisible_characters_keep_places():
    t = "O\u200bne two. Th\u00adree four."
    assert S.sentence_ends(t, MODEL) == [9, len(t)]


def test_long_text_is_linear():
    t = "The dog ran far. " * 20000
    assert len(S.sentence_ends(t, MODEL)) == 20000


def test_learned_abbreviation(docs_of):
    """A token never seen before a blank line doesn't end sentences, whatever its shape."""
    rows = [(i, "They saw Brig. Anders and left.\n\nThe day ended.") for i in range(1000)]
    m = S.learn(docs_of(rows))
    assert m.ends("Brig") < 0.05 < 0.9 < m.ends("ended")
    assert units("They saw Brig. Anders and left. The day ended.", m) == ["They saw Brig. Anders and left.", "The day ended."]
    got = S.sentences(docs_of([(1, None), (2, "One. Two.")]), m).orderBy("end_char").collect()
    assert [(r.doc_id, r.sent_no, r.start_char, r.end_char) for r in got] == [(2, 0, 0, 4), (2, 1, 5, 9)]


def test_vocabulary_beyond_memory_is_exact(docs_of, monkeypatch):
    """Tokens that tasks don't hold have their own counts, so that units don't depend on how many are held."""
    names = " and ".join(f"{n} and {n}" for n in ("Anna", "Otto", "Emil", "Hugo"))
    rows = [(i, f"we saw Vale and {names} there.") for i in range(60)] + [(100 + i, "Vale left us again.") for i in range(5)]
    rows += [(999, "they met Mr. Vale there."), (999, "they met Mr. Vale there."), (998, None), (997, "")]
    docs = docs_of(rows)
    want = sorted(map(tuple, S.sentences(docs).collect()))
    assert want[-2:] == [(999, 0, 0, 24)] * 2
    monkeypatch.setattr(S, "VOCABULARY", 4)  # start then holds Vale, all doesn't
    assert sorted(map(tuple, S.sentences(docs).collect())) == want


def learned(texts):
    return S.Model(S.count_texts(texts))


def test_no_limit_on_quotations():
    """However long a quotation or a run is, its end is found by the same signs."""
    words = "the old mill stood by the river and nobody came " * 200
    assert units(f"„{words}.“ sagte Vera. Dann ging sie.") == [f"„{words}.“ sagte Vera.", "Dann ging sie."]
    assert units(f"“He said: {words}?” Mr. Hugo asked. We left.") == [f"“He said: {words}?” Mr. Hugo asked.", "We left."]
    assert units("a.b" * 20000 + " end. Next one.")[-1] == "Next one."


def test_unspaced_run_is_linear():
    t = "秦露说很好。" * 30000
    assert len(S.sentence_ends(t, MODEL)) == 30000


def test_text_without_marks():
    """Hidden events between words: the n-gram model alone cuts a paragraph that has no marks; an empty model cuts none."""
    subjects, ends = ["The farmer", "Every sailor", "Some teacher"], ["slowly", "yesterday", "alone"]
    texts = [f"{s} walked past the mill {e}. {s2} saw the red boat {e2}." for s in subjects for e in ends for s2 in subjects for e2 in ends] * 20
    for case in (str, str.lower):
        p = case("The farmer saw the red boat yesterday Every sailor walked past the mill alone")
        assert units(p, learned(texts)) == [case("The farmer saw the red boat yesterday"), case("Every sailor walked past the mill alone")]
        assert units(p) == [p]


def test_unpunctuated_script_without_spaces():
    texts = ["秦露很高兴地走了。我们看见了那条小船。", "我们看见了旧书店。秦露很高兴地走了。", "我们很快地走了。秦露看见了那条小船。"] * 50
    p = "秦露很高兴地走了我们看见了那条小船"
    assert units(p, learned(texts)) == ["秦露很高兴地走了", "我们看见了那条小船"] and units(p) == [p]


def test_all_texts_are_learned_from():
    n = S.count_texts(["नमस्ते दुनिया। फिर मिलेंगे।", "no marks at all", None, "", "我们走了。"])
    assert n["any", "marks"] == 1 and n["any", "我们"] == 1 and n["sum", "tokens"] >= 8
