"""Multilingual text search and retrieval as PySpark plans."""

from .functions.analyzer import Analyzer, Token
from .functions.lexicon import DictionaryConfig, ScriptDictionary
from .index import SearchIndex
from .operators.index import Index
from .operators.train import TrainingConfig, train_dictionary_config
from .schema import DOMAINS, SNAPSHOT_VERSION, Domain, PositionEncoding, SearchMode

__all__ = [
    "DOMAINS",
    "SNAPSHOT_VERSION",
    "Analyzer",
    "DictionaryConfig",
    "Domain",
    "Index",
    "PositionEncoding",
    "ScriptDictionary",
    "SearchIndex",
    "SearchMode",
    "Token",
    "TrainingConfig",
    "train_dictionary_config",
]
