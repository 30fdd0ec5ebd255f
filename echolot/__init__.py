"""Duplicate and dead-unit analysis of source code and text, on Spark."""

__version__ = "0.1.0"

from .analyzer import AnalysisResult, Analyzer, AnalyzerConfig, analyze_directory
from .embedding import Embedder, SemanticBackendError, SentenceModel, TermFrequency

__all__ = ["AnalysisResult", "Analyzer", "AnalyzerConfig", "Embedder", "SemanticBackendError", "SentenceModel", "TermFrequency", "analyze_directory"]
