"""Texts garbled by known chains are found and mostly restored; sound texts of many scripts are left alone."""

import pytest

from caseframe.llm import mojibake as M

SOUND = ["Müller & Söhne Kältetechnik", "Société Générale des Écluses", "Compañía Eléctrica Peñasol", "Zakład Usług Sieciowych", "Družstvo Řečiště", "Yıldızçay Üniversitesi", "Администрация посёлка Верхний Яр", "Ινστιτούτο Θάλασσας", "don’t send mail – use the portal", "白浜通信組合", "Öffnungszeiten nach Absprache", "réseau géré par la société", "zgłoszenia przyjmuje dyżurny", "hlášení závad přijímá ústředna", "geçici kullanım süresi doldu", "обращаться в службу", "επικοινωνία με την υπηρεσία", "informações com a equipe técnica"]
TRAPS = ["25 °C Serverraum", "n° 4 — 2º piso", "½ rack, 3 µs", "¿dudas? ¡llame!", "«Réseau» du Crêt", "SÃO BRÍCIO NET", "Ä/Ö/Ü", "PÃO & CIA", "§ 12 – gültig ab 1. März"]


@pytest.fixture(scope="module")
def model():
    m = M.Model(SOUND)
    m.ready()
    return m


def garble(text, written, read):
    return text.encode(written).decode(read, "strict")


@pytest.mark.parametrize("text", SOUND + TRAPS)
def test_sound(model, text):
    assert model.field(text) == (False, None)
    assert model.field(f"plain words\n{text}; more (aside)") == (False, None)


CHAINS = [("utf-8", "latin-1"), ("utf-8", "mac_roman"), ("utf-8", "cp437"), ("utf-8", "cp850"), ("cp1251", "latin-1"), ("koi8_r", "latin-1"), ("cp1253", "latin-1"), ("cp1250", "latin-1"), ("cp932", "latin-1"), ("euc_jp", "latin-1"), ("cp1252", "cp437"), ("cp1252", "mac_roman"), ("cp437", "latin-1")]


def test_restored(model):
    tried = found = restored = 0
    for text in SOUND:
        for written, read in CHAINS:
            try:
                bad = garble(text, written, read)
            except UnicodeError:
                continue
            if bad == text or bad.isascii():
                continue
            tried += 1
            hit, fixed = model.field(f"static pool / {bad} #12")
            found += hit
            restored += fixed == f"static pool / {text} #12"
    assert tried > 100 and found >= 0.97 * tried and restored >= 0.9 * tried


def test_twice(model):
    bad = garble(garble("Société Générale", "utf-8", "latin-1"), "utf-8", "latin-1")
    assert model.field(bad) == (True, "Société Générale")


def test_lost(model):
    assert model.field("M�ller") == (True, None)
    assert model.field(None) == model.field("") == model.field("plain?") == (False, None)


def test_table(spark):
    rows = [(100 + i, s, None, i) for i, s in enumerate(SOUND * 5)] + [(2, garble(SOUND[0], "utf-8", "latin-1"), "", 0), (2, garble(SOUND[0], "utf-8", "latin-1"), "", 0), (3, "ok", "x" * 50_000 + garble("é", "utf-8", "latin-1"), 1), (None, "Ã©", None, 1)]
    df = spark.createDataFrame(rows, "id int, a string, b string, text int")
    got = {(r["id"], r["field"]): r["restored"] for r in M.garbled(df, "id", ["a", "b"]).collect()}
    assert got == {(2, "a"): SOUND[0], (3, "b"): "x" * 50_000 + "é"}
    assert M.garbled(df.limit(0), "id", ["a", "b"]).count() == 0


def test_trained_on_everything(spark, monkeypatch):
    """No number of stretches or of letters is too large to be counted: the tallies hold every word of every sound stretch, also
    of 4,100 that occur once and of one with 9,000 letters."""
    syllables = ["kä", "lö", "mü", "ra", "ne", "ti", "so", "du", "be", "ga", "fi", "wo", "la", "he", "ri", "nu"]
    words = [f"mü{a}{b}{c}" for a in syllables for b in syllables for c in syllables] + ["fähre", "größe", "übung", "schön"]
    long = " ".join(f"wäge{a}{b}" for a in syllables for b in syllables) + " räume" * 1_000
    rows = [(s, 3) for s in SOUND] + [(w, 1) for w in words] + [(long, 1)]
    learned = []
    monkeypatch.setattr(M.Model, "learn", lambda self, counts, learn=M.Model.learn: (learned.append(counts), learn(self, counts)) and None)
    M.ensure_checkpoint_dir(spark)
    stretches = spark.createDataFrame(rows, "own string, n long")
    model = M.trained(stretches)
    assert len(learned) == 2 * M.ROUNDS
    first = M.Model(SOUND)
    assert {n: p.raw for n, p in first.packers.items()} == {n: p.raw for n, p in M.modelled(stretches.filter("n = 3").select("own")).packers.items()}
    first.ready()
    sound = [s for s, n in rows if n == 3 or not first.judge(s)[0]]
    assert len(sound) > 4_080 and long in sound
    all_words = {w for s in sound for w in s.split(" ")}
    taught = M.Model(sound)
    assert {n: p.raw for n, p in taught.packers.items()} == {n: p.raw for n, p in model.packers.items()}
    # Before there are dictionaries a stretch teaches every language that may have written it.
    in_all = learned[2]
    assert in_all["de"][0] >= len({w for s in sound for w in s.split(" ") if "ä" in w and "é" not in w and "Ã" not in w}) > 700
    assert in_all[""][0] == len({*M.COMMON} | {w for w in all_words if w.isascii()})


def test_without_garbled(spark):
    bad = garble("Müller & Söhne", "utf-8", "latin-1")
    rows = [("Müller & Söhne", 5), (bad, 3), ("M\ufffdller", 9), (garble("été", "utf-8", "latin-1"), 4), ("été", 4), ("été #2", 3)]
    got = {r["own"] for r in M.without_garbled(spark.createDataFrame(rows, "own string, n long")).collect()}
    assert got == {"Müller & Söhne", garble("été", "utf-8", "latin-1"), "été", "été #2"}
