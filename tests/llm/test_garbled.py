import pytest

from millrace.llm import garbled as g

GOOD = "Łąkowo café “x” – 20 °C ± ½ €5 naïve Größe São À côté d’été ✔ ™ 東町 «Зоря» Ω É… ÇÕES CHÂTEAU ÂGE FORMAÇÃO Rattaché·e l’équipe Ångström hall Ð4 ÚNICA"


def test_correct_text_is_left_alone():
    for text in (GOOD, GOOD.upper(), "", "plain ascii", "IRMÃ", "théâtre pâte", "à la carte"):
        assert g.spans(text) == []
        assert g.restore(text) == (text, 0, 0)


CORRECT = (
    "O pâine caldă, un câine și mâine o hotărâre; când râd, sâmbătă, în vârstă.",
    "Tâm ân, tấm lòng; bà ấy nói: “đã thấy”, âm nhạc, cần, NGÂN HÀNG, HÃNG PHIM VIỆT.",
    "São João, AMANHÃ NÃO HÁ PÃES, maçã, irmãs, avó – pão; FORMAÇÃO e CORAÇÃO.",
    "Hâlâ kâr ediyor, rüzgârlı, şöyle; ĞÜZEL GÜNLER… İŞ", "Лёша и Всё её «В доме» — моё… Щёлк, её» и Сёла", "L’École «État» d’été, l’âge, le mât, dégât, ÂGE… À côté; CAFÉ…", "Größe – Straße… „Gruß“ ÜBERÖÄ Öl",
    "Årsmöte på Åland, ÅÄÖ", "Zażółć gęślą jaźń… ŁÓDŹ", "Ελληνικά, ΌΧΙ…", "Ñandú, ESPAÑA… ¿Qué? «Ñ»", "🚀 ok ▲ ½ ± 5 °C × 3")


@pytest.mark.parametrize("text", CORRECT)
def test_correct_texts_of_many_languages(text):
    assert g.spans(text) == [] and g.restore(text) == (text, 0, 0)


@pytest.mark.parametrize("wrong", g.WRONG)
def test_round_trip(wrong):
    bad = g._misread(GOOD.encode(), wrong)
    fixed, n, lost = g.restore(bad)
    kept = GOOD.replace("東", "") if wrong == "cp437" else GOOD  # there this character has another reading under cp850
    assert (fixed.replace("µ¥▒", "") if wrong == "cp437" else fixed) == kept and n > 20 and lost == (wrong == "cp437")


@pytest.mark.parametrize("text", ["launch \U0001f680 now", "face \U0001f900", "chữ viết tiếng Việt", "שלום", "한국어 글", "ไทย", "naïve – café"])
def test_every_assigned_character(text):
    """All characters of three and four bytes, not only those of a list."""
    for wrong in ("cp1252", "latin-1"):
        bad = g._misread(text.encode(), wrong)
        assert g.restore(bad)[0] == text, (wrong, bad)


def test_many_times_over():
    text = "naïve café – 5 °C"
    bad = text
    for _ in range(5):
        bad = g._misread(bad.encode(), "cp1252")
    assert g.restore(bad)[0] == text


def test_twice_over():
    once = g._misread("naïve café – 5 °C".encode(), "cp1252")
    twice = g._misread(once.encode(), "latin-1")
    assert g.restore(twice)[0] == "naïve café – 5 °C"


def test_mixed_text_changes_only_the_span():
    assert g.restore("déjà vu, cafÃ© – Größe")[0] == "déjà vu, café – Größe"


def test_lost_characters_are_found_not_restored():
    fixed, n, lost = g.restore("caf� at 5 �C")
    assert (n, lost) == (2, 2) and fixed == "caf� at 5 �C"
    assert g.spans("youâll like it") and g.spans("in hall Ã4.") and g.spans("faire Ãberstunden")


def test_repair(spark):
    rows = [(1, "cafÃ©", "a"), (1, "cafÃ©", "a"), (2, None, "b"), (3, "", None), (4, "fine", None), (5, "x" * 300_000 + "â€“", None), (None, "Â°", None)]
    df = spark.createDataFrame(rows, "row_id long, text string, restored string")
    got = sorted(((r.id or 0), r.restored[-4:], r.n_garbled, r.n_lost) for r in g.repair(df, "row_id", "text").collect())
    assert got == [(0, "°", 1, 0), (1, "café", 1, 0), (1, "café", 1, 0), (5, "xxx–", 1, 0)]
    assert g.repair(df.limit(0), "row_id", "text").count() == 0
