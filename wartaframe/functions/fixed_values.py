"""These must equal the published word lists and limits.

Stopwords, the weighted lexicon and the stem table are inputs, not constants.
"""

MONTHS = {
    "Januari": 1, "Februari": 2, "Maret": 3, "April": 4,
    "Mei": 5, "Juni": 6, "Juli": 7, "Agustus": 8,
    "September": 9, "Oktober": 10, "November": 11, "Desember": 12,
}

LABELS = {"positif": "Positif", "negatif": "Negatif", "netral": "Netral"}

UI_ARTIFACTS = ["preferredsource", "add preferred source", "opening in another tab"]
MIN_ARTICLE_WORDS = 40

STATUS_FULL = "Teks Lengkap"
STATUS_SUMMARY = "Ringkasan RSS"
STATUS_TITLE = "Judul Saja"
UNKNOWN_SOURCE = "Tidak diketahui"
OTHER_TOPIC = "Lainnya"

SLANG = {
    "gak": "tidak", "ga": "tidak", "nggak": "tidak", "enggak": "tidak",
    "yg": "yang", "dg": "dengan", "dgn": "dengan", "utk": "untuk",
    "krn": "karena", "karna": "karena", "sdh": "sudah", "udah": "sudah",
    "blm": "belum", "tdk": "tidak", "jgn": "jangan",
    "bgt": "banget", "skrg": "sekarang", "pemda": "pemerintah daerah",
    "pemprov": "pemerintah provinsi", "bi": "bank indonesia",
}

POST_STEM_STOPWORDS = [
    "jadi", "kata", "sebut", "ungkap", "tutur", "guna", "tunjuk", "lapor",
]

DIRECTION_UP = ["naik", "tingkat", "lonjak", "kuat", "lambung"]
DIRECTION_DOWN = [
    "turun", "anjlok", "merosot", "lemah", "lambat", "susut", "tajam", "jatuh",
    "landai", "krisis", "gagal",
]
STATIC_UP = ["tinggi", "besar", "mahal", "berat"]
STATIC_DOWN = ["rendah", "kecil", "murah", "ringan"]
NEGATIVE_IF_UP = [
    "harga", "inflasi", "angguran", "miskin", "utang", "defisit",
    "kriminal", "jahat", "celaka", "korupsi", "polusi",
    "macet", "bunga", "tarif", "beban", "biaya", "pajak", "ongkos",
    "krisis", "rugi", "phk", "curi", "tipu", "senjang", "tekan", "tunggak",
    "lonjak",
]
POSITIVE_IF_UP = [
    "dapat", "ekspor", "investasi", "produksi", "jual",
    "ihsg", "saham", "gaji", "upah", "tumbuh", "surplus",
    "cadang", "wisata", "kunjung", "pdb", "laba", "untung", "profit",
    "produktivitas", "kerja",
]
DIRECTION_WEIGHT = 3
DIRECTION_WINDOW = 4

NEUTRAL_BAND = 0.15
NEAR_DUPLICATE_THRESHOLD = 0.85
SEED = 42

POOL_MULTIPLIER = 4
POOL_CAP = 1500
MIN_ROWS_TO_TRAIN = 10
MIN_GOLDEN_ROWS = 30
MIN_EVALUATED_ROWS = 5
ANNOTATION_CHARS = 1200
PAGE_SIZE = 10
