"""Small dimension tables and fixed value lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Group dimension (code, name, family, typology, iso639_3).
GROUPS = [
    ("en_US", "English", "Germanic", "Fusional", "eng"),
    ("fr_FR", "French", "Romance", "Fusional", "fra"),
    ("es_ES", "Spanish", "Romance", "Fusional", "spa"),
    ("de", "German", "Germanic", "Fusional", "deu"),
    ("nl", "Dutch", "Germanic", "Fusional", "nld"),
    ("cmn", "Mandarin Chinese", "Sino-Tibetan", "Isolating", "cmn"),
    ("jpn", "Japanese", "Japonic", "Agglutinative", "jpn"),
    ("ara", "Arabic", "Semitic", "Fusional", "arb"),
    ("fin", "Finnish", "Uralic", "Agglutinative", "fin"),
    ("tur", "Turkish", "Turkic", "Agglutinative", "tur"),
    ("hin", "Hindi", "Indo-Aryan", "Fusional", "hin"),
    ("swa", "Swahili", "Bantu", "Agglutinative", "swh"),
]

# File name prefix of a lexicon and its group.
PREFIXES = [
    ("eng_latn_us", "en_US"), ("fra_latn", "fr_FR"), ("spa_latn_la", "es_ES"), ("spa_latn_ca", "es_ES"), ("deu_latn", "de"),
    ("nld_latn", "nl"), ("zho_hani", "cmn"), ("jpn_hira", "jpn"), ("ara_arab", "ara"), ("fin_latn", "fin"), ("tur_latn", "tur"),
    ("hin_deva", "hin"), ("swa_latn", "swa"),
]

# Vowel letters of the default and of the legacy mode.
VOWELS = "iyɨʉɯuɪʏʊeøɘɵɤoəɛœɜɞʌɔæɐaɶɑɒ"
LEGACY_VOWELS = "iɪeɛæaɑɒɔʌəɜɝɚuʊoøyɨʉɯɐœɶ"

# Signs that carry prosody, marks that never tell tokens apart, and mappings by group.
PROSODIC = "ˈˌ.‿|‖"
PREDICTABLE_MARKS = "̩̯̥̟̠"
TOKEN_MAPS = {"en_US": {"ɫ": "l", "ɾ": "t"}, "es_ES": {"β": "b", "ð": "d", "ɣ": "ɡ"}}

# Broad sound classes for the similarity of two tokens.
SOUND_CLASSES = {
    "vowel": "aeiouæɑɒəɛɜɪɔʊʌɤøœɵɶɐ",
    "plosive": "pbtdɖɟcɡkqʔ",
    "fricative": "fvθðszʃʒɕʑçxɣχʁħʕhɦβɸ",
    "nasal": "mnɲŋɳɴ",
    "liquid": "lɫɭɹɻrɾʀʁ",
}

# Consonants (token, voiced, place, manner).
CONSONANTS = [
    ("p", False, "Bilabial", "Plosive"), ("b", True, "Bilabial", "Plosive"), ("t", False, "Alveolar", "Plosive"),
    ("d", True, "Alveolar", "Plosive"), ("k", False, "Velar", "Plosive"), ("ɡ", True, "Velar", "Plosive"),
    ("m", True, "Bilabial", "Nasal"), ("n", True, "Alveolar", "Nasal"), ("ŋ", True, "Velar", "Nasal"),
    ("f", False, "Labiodental", "Fricative"), ("v", True, "Labiodental", "Fricative"), ("θ", False, "Dental", "Fricative"),
    ("ð", True, "Dental", "Fricative"), ("s", False, "Alveolar", "Fricative"), ("z", True, "Alveolar", "Fricative"),
    ("ʃ", False, "Post-alv.", "Fricative"), ("ʒ", True, "Post-alv.", "Fricative"), ("h", False, "Glottal", "Fricative"),
    ("j", True, "Palatal", "Approximant"), ("w", True, "Labio-velar", "Approximant"), ("ɹ", True, "Alveolar", "Approximant"),
    ("l", True, "Alveolar", "Lateral"), ("ɲ", True, "Palatal", "Nasal"), ("c", False, "Palatal", "Plosive"),
    ("ɟ", True, "Palatal", "Plosive"), ("x", False, "Velar", "Fricative"), ("ɣ", True, "Velar", "Fricative"),
    ("ʀ", True, "Uvular", "Trill"), ("r", True, "Alveolar", "Trill"), ("ɾ", True, "Alveolar", "Tap"),
    ("q", False, "Uvular", "Plosive"), ("ʔ", False, "Glottal", "Plosive"),
]

# Vowels (token, height, backness, rounded).
VOWEL_FEATURES = [
    ("i", "Close", "Front", False), ("u", "Close", "Back", True), ("ɪ", "Near-close", "Front", False), ("ʊ", "Near-close", "Back", True),
    ("e", "Close-mid", "Front", False), ("o", "Close-mid", "Back", True), ("ə", "Mid", "Central", False), ("ɛ", "Open-mid", "Front", False),
    ("ɔ", "Open-mid", "Back", True), ("æ", "Near-open", "Front", False), ("a", "Open", "Front", False), ("ɑ", "Open", "Back", False),
    ("ɒ", "Open", "Back", True), ("ʌ", "Open-mid", "Back", False), ("ɝ", "Mid", "Central", False), ("y", "Close", "Front", True),
    ("ø", "Close-mid", "Front", True), ("œ", "Open-mid", "Front", True),
]

# The order in which families are shown; others come last.
FAMILY_ORDER = ["Germanic", "Romance", "Sino-Tibetan", "Japonic", "Semitic", "Uralic", "Turkic", "Indo-Aryan", "Bantu"]


def group_dim(spark: SparkSession, rows: list[tuple] = GROUPS) -> DataFrame:
    return spark.createDataFrame(rows, "code string, name string, family string, typology string, iso639_3 string")


def prefix_dim(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PREFIXES, "prefix string, grp string")


def consonant_dim(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CONSONANTS, "token string, voiced boolean, place string, manner string")


def vowel_dim(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(VOWEL_FEATURES, "token string, height string, backness string, rounded boolean")
