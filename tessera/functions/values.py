"""Results depend on these exact words, labels, patterns and their order."""

# Ordered rewrites of English terms.
TERM_REWRITES = [
    ("Gemara", "Talmud"),
    ("Rabbi", "R'"),
    ("The Sages taught", "A baraita states"),
    ("Divine Voice", "bat kol"),
    ("Divine Presence", "Shekhina"),
    ("divine inspiration", "Holy Spirit"),
    ("Divine Spirit", "Holy Spirit"),
    ("the Lord", "YHWH"),
    ("leper", "metzora"),
    ("leprosy", "tzara'at"),
    ("phylacteries", "tefillin"),
    ("gentile", "non-Jew"),
    ("gentiles", "non-Jews"),
    ("ignoramus", "am ha'aretz"),
    ("maidservant", "female slave"),
    ("maidservants", "female slaves"),
    ("barrel", "jug"),
    ("barrels", "jugs"),
    ("the Holy One, Blessed be He", "God"),
    ("the Merciful One", "God"),
    ("the Almighty", "God"),
    ("engage in intercourse", "have sex"),
    ("engages in intercourse", "has sex"),
    ("engaged in intercourse", "had sex"),
    ("engaging in intercourse", "having sex"),
    ("had intercourse", "had sex"),
    ("intercourse with", "sex with"),
    ("Sages", "rabbis"),
    ("mishna", "Mishnah"),
    ("rainy season", "winter"),
    ("son of R'", "ben"),
]
# Of these, the ones replaced as they stand, case and all, without word boundaries.
PLAIN_REWRITES = {"son of R'", "intercourse with"}

# Replaced in displayed text nodes, in this order, as they stand.
DISPLAY_REWRITES = [("the Holy One, Blessed be He", "God"), ("the Lord", "YHWH"), ("Gemara ", "Talmud "), ("Rabbi ", "R' ")]

# Entity labels that are not shown unless a dictionary has the entity.
HIDDEN_LABELS = ["ORG", "WORK_OF_ART", "FAC", "PRODUCT", "EVENT", "LAW", "LANGUAGE", "PERCENT", "MONEY"]

# Words that are never persons, and names that make a concept.
NON_PERSONS = [
    "lest", "yhwh", "lord", "god", "today", "tomorrow", "yesterday", "this", "that", "these", "those", "when", "where", "why", "how",
    "what", "which", "who", "whom", "whose", "will", "would", "could", "should", "might", "may", "can", "must", "shall",
]
DIVINE_NAMES = ["yhwh", "lord", "god", "hashem", "adonai"]

# What a noun phrase must hold for a topic.
TOPIC_WORDS = [("prayer", "prayer"), ("blessings", "blessings"), ("law", "halacha"), ("halakha", "halacha"), ("story", "aggadah"), ("aggadah", "aggadah"), ("shabbat", "shabbat")]

# Letters of a name token, and vowel signs and accents.
NAME_TOKEN = r"[A-Za-zĀ-ɏḀ-ỿ'-]+"
VOWEL_SIGNS = r"[֑-ׇ]"
SENTENCE_ENDS = r"[.!?׃։]"

# Characters a page export puts a backslash before.
MARKDOWN_MARKS = r"([\\`*_{}\[\]()#+.!-])"

# Order in which an annotation looks a key up; lower wins.
PAGE_PRIORITY = ["concept", "topic", "person", "place", "bible"]
# Which dictionary names a term of a section; lower wins.
SECTION_PRIORITY = ["person:bible", "place:bible", "person", "place", "concept"]
