"""Models of symbols in context."""

from surprisal.models.base import Model
from surprisal.models.huffman import Huffman
from surprisal.models.kneser_ney import KneserNey
from surprisal.models.ppm import PPM
from surprisal.models.unigram import Unigram

__all__ = ["PPM", "Huffman", "KneserNey", "Model", "Unigram"]
