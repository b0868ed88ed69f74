import pytest

from quernel.llm import language as L

# Sentences of our own, so that profiles can be fitted without the corpus.
TEXTS = {
    "en": ["The weather was so bad that we could not leave the house until the morning.", "Which of these books would you like to read with the children this week?", "There are many people who think that the answer should be given now."],
    "de": ["Das Wetter war so schlecht, dass wir das Haus bis zum Morgen nicht verlassen konnten.", "Welches von diesen Büchern möchtest du diese Woche mit den Kindern lesen?", "Es gibt viele Leute, die glauben, dass die Antwort jetzt gegeben werden sollte."],
    "fr": ["Le temps était si mauvais que nous ne pouvions pas quitter la maison avant le matin.", "Lequel de ces livres voudrais-tu lire avec les enfants cette semaine ?", "Il y a beaucoup de gens qui pensent que la réponse devrait être donnée maintenant."],
    "es": ["El tiempo era tan malo que no pudimos salir de la casa hasta la mañana.", "¿Cuál de estos libros te gustaría leer con los niños esta semana?", "Hay muchas personas que piensan que la respuesta debería darse ahora."],
    "it": ["Il tempo era così brutto che non potevamo uscire di casa fino al mattino.", "Quale di questi libri vorresti leggere con i bambini questa settimana?", "Ci sono molte persone che pensano che la risposta dovrebbe essere data adesso."],
    "nl": ["Het weer was zo slecht dat we het huis niet konden verlaten tot de ochtend.", "Welke van deze boeken zou je deze week met de kinderen willen lezen?", "Er zijn veel mensen die denken dat het antwoord nu gegeven moet worden."],
    "pt": ["O tempo estava tão ruim que não pudemos sair de casa até a manhã.", "Qual destes livros você gostaria de ler com as crianças esta semana?", "Há muitas pessoas que pensam que a resposta deveria ser dada agora."],
}


@pytest.fixture(scope="module")
def profiles():
    rows = [(t, lang) for lang, texts in TEXTS.items() for t in texts * 3]
    return L.fit([*rows, (TEXTS["en"][0], "nl"), (TEXTS["de"][1], "fr")])  # two wrong labels


def test_read_label():
    for label, want in [("en", "en"), ("eng", "en"), ("English", "en"), ("en-US", "en"), ("en_GB", "en"), ("DE ", "de"), ("ger", "de"), ("pt-BR", "pt"), ("Dutch", "nl"), ("fr-CA", "fr"), ("", None), (" ", None), ("und", None), ("n/a", None), ("unknown", None), (None, None), ("pl", "pl"), ("Polish", "polish"), ("Brazilian Portuguese", "pt"), ("English (US)", "en"), ("zh-DE", "zh"), ("not applicable", None), ("?", None)]:
        assert L.read_label(label) == want, label


def test_single_languages(profiles):
    for lang, texts in TEXTS.items():
        for t in texts:
            assert [s[0] for s in profiles.stretches(t)] == [lang]
            assert [s[0] for s in profiles.stretches(t.upper())] == [lang]


def test_mixed(profiles):
    text = TEXTS["de"][0] + " " + TEXTS["es"][2] + "\n" + TEXTS["de"][2]
    got = profiles.stretches(text)
    assert [s[0] for s in got] == ["de", "es", "de"]
    assert text[got[1][2] : got[1][3]] == TEXTS["es"][2].rstrip(".")
    assert all(0 <= s[1] <= 1 for s in got)


def test_no_words(profiles):
    for t in ("", "   ", "12 34-5", "SO-2512-1 -> SO-2512-2", "a@b.example", "sku=AX-1", "x_y_z"):
        assert profiles.stretches(t) == []


def test_long_text(profiles):
    text = " ".join(TEXTS["fr"] * 400 + TEXTS["nl"] * 400)
    assert [s[0] for s in profiles.stretches(text)] == ["fr", "nl"]


def test_table(spark, profiles):
    df = spark.createDataFrame([(1, TEXTS["it"][0], "n"), (2, None, None), (3, "", "x"), (3, TEXTS["it"][0], "x")], "id int, q string, lang string")
    got = {(r["id"], r["q"]): [s["lang"] for s in r["stretches"]] for r in L.detect(df, "q", profiles).collect()}
    assert got == {(1, TEXTS["it"][0]): ["it"], (2, None): [], (3, ""): [], (3, TEXTS["it"][0]): ["it"]}
    assert L.detect(df.where("false"), "q", profiles).count() == 0
    fitted = L.fit_on(spark.createDataFrame([(t, lang.upper()) for lang, ts in TEXTS.items() for t in ts], "t string, l string"), "t", "l")
    assert fitted.stretches(TEXTS["pt"][1])[0][0] == "pt"
    assert L.fit_on(df.where("false"), "q", "lang").stretches("any text") == []


def test_unbroken_text(profiles):
    assert len(profiles.stretches("x" * 300_000)) <= 1
    assert profiles.stretches("1" * 300_000) == []
    assert [s[0] for s in profiles.stretches("a=" * 100_000 + " " + TEXTS["de"][2])] == ["de"]


def test_sample_is_not_thinned_further():
    from quernel.llm import language

    assert language.SAMPLE_ROWS >= 20_000


def test_other_languages_that_are_labelled(spark):
    """Whatever is labelled often enough has a profile, and no other text is forced into the seven."""
    sv = ["vilka kunder har köpt mest", "hur många order kom in igår", "visa intäkterna per region och månad", "varför är rabatten så hög"]
    en = ["which customers bought the most", "how many orders came in yesterday", "show revenue by region and month", "why is the discount so high"]
    rows = [(f"{a} {b} {i}", lang) for lang, some in (("sv", sv), ("en", en)) for a in some for b in some for i in range(3)] + [("x y", "rare"), (None, "sv"), ("q", None)]
    df = spark.createDataFrame(rows, "t string, l string")
    p = L.fit_on(df, "t", "l")
    assert p.langs == ["en", "sv"]
    assert [s[0] for s in p.stretches("hur många kunder kom in igår")] == ["sv"]
    assert L.fit_on(df, "t", "l", languages={"en"}).langs == ["en"]
