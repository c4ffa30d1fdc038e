"""Per-session corpus artefacts, built once per input directory and reused.

The reference builds its vector index once and reloads it (its setup flag),
and caches its global term statistics between runs.  The same holds here:
the postings index, the lemma set and the global term scores of a corpus are
written once as Parquet tables in the checkpoint folder and every check or
round that needs them reads those tables.  They lie beside the checkpoint folder under a name made from the input files, with a
manifest, so that a second process with the same folder reads them as well.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from kestrel.plans.rounds import Corpus, prepare_corpus
from kestrel.plans.run_store import key_of, shared_root
from kestrel.sources import driver
from kestrel.sources.io import source_fingerprint

_CORPORA: dict[tuple[str, str, str], Corpus] = {}


def corpus_for(spark: SparkSession, sf_dir: str) -> Corpus:
    # new data under the same path is another corpus
    root = sf_dir.rstrip("/")
    key = (spark.sparkContext.applicationId, root, source_fingerprint(spark, f"{root}/documents.parquet"))
    if key not in _CORPORA:
        docs = driver.table(spark, sf_dir, "documents").select("doc_id", "text")
        folder = f"{shared_root(spark, 'kestrel-corpora')}/corpus={key_of(*key[1:])}"
        _CORPORA[key] = Corpus(docs, folder)  # its parts are made when they are asked for
    return _CORPORA[key]


def rebuild(spark: SparkSession, sf_dir: str) -> Corpus:
    """Builds the corpus tables anew, whatever is stored, and has this session use them."""
    docs = driver.table(spark, sf_dir, "documents").select("doc_id", "text")
    root = sf_dir.rstrip("/")
    key = (spark.sparkContext.applicationId, root, source_fingerprint(spark, f"{root}/documents.parquet"))
    _CORPORA[key] = prepare_corpus(docs)
    return _CORPORA[key]
