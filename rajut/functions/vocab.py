"""Closed vocabularies. All values here are fixed: results depend on them."""

from __future__ import annotations

# fixed values: relation types within one book
RELATION_TYPES = (
    "BAGIAN_DARI",
    "MENYEBABKAN",
    "BERGANTUNG_PADA",
    "MENDEFINISIKAN",
    "MEMPENGARUHI",
    "BERINTERAKSI_DENGAN",
    "MEMUNGKINKAN",
    "MENGATUR",
    "TERDIRI_DARI",
    "BEREAKSI_DENGAN",
    "MENGHASILKAN",
    "TERLETAK_DI",
    "DIFORMULASIKAN_SEBAGAI",
    "DIKATALISIS_OLEH",
    "MEMILIKI_SIFAT",
)

# fixed values: other spellings of relation types
RELATION_SYNONYMS = {
    "MENENTUKAN": "MEMPENGARUHI",
    "MENGONTROL": "MEMPENGARUHI",
    "MENGARAHKAN": "MEMPENGARUHI",
    "MENGANDUNG": "BAGIAN_DARI",
    "MEMILIKI": "BAGIAN_DARI",
    "BERKAITAN_DENGAN": "BERINTERAKSI_DENGAN",
    "BERHUBUNGAN_DENGAN": "BERINTERAKSI_DENGAN",
    "BERASOSIASI_DENGAN": "BERINTERAKSI_DENGAN",
    "MENIMBULKAN": "MENYEBABKAN",
    "MEMPRODUKSI": "MENGHASILKAN",
    "MENGHASILKAN_PRODUK": "MENGHASILKAN",
    "TAHAP_DARI": "BAGIAN_DARI",
    "LANGKAH_DARI": "BAGIAN_DARI",
    "TAHAPAN_DARI": "BAGIAN_DARI",
    "LANGKAH_DALAM": "BAGIAN_DARI",
    "MEMBUTUHKAN": "BERGANTUNG_PADA",
    "MENGGUNAKAN": "BERGANTUNG_PADA",
    "MEMERLUKAN": "BERGANTUNG_PADA",
    "MENJELASKAN": "MENDEFINISIKAN",
    "MENGURAIIKAN": "MENDEFINISIKAN",
    "MENGGAMBARKAN": "MENDEFINISIKAN",
    "DIUKUR_DENGAN": "DIFORMULASIKAN_SEBAGAI",
    "DIREPRESENTASIKAN_SEBAGAI": "DIFORMULASIKAN_SEBAGAI",
}

# fixed values: relation types between books; the classifier may also answer none
CROSS_PREFIX = "LINTAS_BUKU"
CROSS_TYPES = (
    "LINTAS_BUKU_SAMA_DENGAN",
    "LINTAS_BUKU_APLIKASI_DARI",
    "LINTAS_BUKU_PRASYARAT_UNTUK",
    "LINTAS_BUKU_MEMPERDALAM",
    "LINTAS_BUKU_BERKAITAN_DENGAN",
)
OTHER_CROSS_TYPES = ("isPrerequisiteOf", "supports", "analogousTo")
NO_TYPE = "none"
SIMILAR = "SIMILAR_TO"

# fixed values
SYMMETRIC_TYPES = ("BERINTERAKSI_DENGAN", "BEREAKSI_DENGAN", "LINTAS_BUKU_SAMA_DENGAN", "LINTAS_BUKU_BERKAITAN_DENGAN")
HIERARCHICAL_TYPES = ("BAGIAN_DARI", "TERDIRI_DARI", "LINTAS_BUKU_PRASYARAT_UNTUK")
STRUCTURAL_TYPES = ("HAS_CHAPTER", "HAS_SUBTOPIC", "HAS_CONCEPT", "NEXT_CHAPTER")

# fixed values: expert labels
LABELS = ("correct", "wrong", "partial", "missing", "abaikan")
SCORED_LABELS = ("correct", "partial", "wrong", "missing")
LABEL_ALIASES = {"ignore": "abaikan", "ignored": "abaikan", "skip": "abaikan", "skipped": "abaikan"}
AGREED_RATINGS = "Auto-agreed: both reviewers gave the same label."
AGREED_MISSING = "Auto-agreed: both reviewers added the same missing triple."

# fixed values: words without meaning for retrieval and for token links
CONTEXT_STOPWORDS = (
    "yang", "dan", "atau", "dengan", "untuk", "pada", "dari", "dalam", "adalah", "kelas", "xii", "chapter", "subject", "relation", "target",
    "description", "memiliki", "sifat", "diformulasikan", "sebagai", "mengatur",
)
TOKEN_STOPWORDS = (
    "dan", "atau", "yang", "di", "ke", "dari", "untuk", "pada", "dengan", "dalam", "suatu", "adalah", "merupakan", "sebagai", "oleh", "itu", "ini", "bab",
    "materi", "konsep", "proses", "sistem", "bagian", "jenis", "teori", "hukum", "kelas", "xii",
)

# fixed values: embedding dimensions by part of the model's name, first match wins
EMBEDDING_DIMS = {
    "gemini-embedding": 3072,
    "text-embedding-3-small": 1536,
    "text-embedding-3-large": 3072,
    "multilingual-e5-small": 384,
    "bge-small": 384,
    "bge-base": 768,
    "bge-large": 1024,
    "qwen3-embedding": 4096,
}
DEFAULT_DIM = 768

#: Least confidence by relation type, and for all others.
CONFIDENCE_GATE = {"LINTAS_BUKU_BERKAITAN_DENGAN": 0.85}
DEFAULT_GATE = 0.7
