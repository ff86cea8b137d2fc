"""Relevance-ranked search on Spark, and operators that prepare training corpora."""

from .api import ActivityUpdate, FileSearchResult, LineMatch, SearchResult, SkippedFile, magic_file_search, magic_search, search
from .plans.query import FieldConfig, FileQ, MatchType, Q

__all__ = ["ActivityUpdate", "FieldConfig", "FileQ", "FileSearchResult", "LineMatch", "MatchType", "Q", "SearchResult", "SkippedFile", "magic_file_search", "magic_search", "search"]
