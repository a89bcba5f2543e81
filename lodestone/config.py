"""Constants of the retrieval and validation operators: fixed values that results depend on."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Settings:
    # search
    bm25_k1: float = 1.5
    bm25_b: float = 0.75
    vector_candidates: int = 25
    bm25_candidates: int = 20
    keyword_candidates: int = 15
    metadata_candidates: int = 10
    fts_min_rank: float = 0.01
    # fusion
    vector_weight: float = 0.45
    bm25_weight: float = 0.30
    keyword_weight: float = 0.25
    metadata_weight: float = 0.05
    rrf_k: int = 60
    exact_boost: float = 2.0
    two_channels: float = 1.15
    three_channels: float = 1.10
    fused_candidates: int = 15
    # rerank
    rerank_top: int = 6
    rerank_score_weight: float = 0.70
    rerank_fusion_weight: float = 0.30
    rerank_fusion_scale: float = 30.0
    # context
    context_chars: int = 48_000
    chunk_chars: int = 6_000
    truncation_share: float = 0.7
    least_remaining: int = 300
    marker_room: int = 60
    source_share: float = 0.40
    max_sources: int = 5
    support_score: float = 0.18
    session_messages: int = 4
    session_chars: int = 2_000
    message_chars: int = 500
    # intent
    keyword_threshold: float = 0.60
    semantic_threshold: float = 0.60
    keyword_hit: float = 0.25
    semantic_hit: float = 0.30
    # complexity and routing
    simple_below: float = 0.30
    complex_above: float = 0.70
    weight_steps: float = 0.30
    weight_reasoning: float = 0.25
    weight_context: float = 0.15
    weight_doubt: float = 0.20
    weight_documents: float = 0.10
    agent_score: float = 0.65
    agent_sources: int = 1
    agent_tokens: int = 8_000
    agent_steps: int = 4
    # validation
    weight_retrieval: float = 0.30
    weight_coverage: float = 0.25
    weight_grounding: float = 0.25
    weight_consistency: float = 0.20
    least_confidence: float = 0.35
    least_grounding: float = 0.25
    superseded_penalty: float = 0.20
    # ingestion
    max_file_mb: int = 100
    chunk_min_chars: int = 200
    chunk_max_chars: int = 6_000
    chunk_batch: int = 6


SETTINGS = Settings()

#: Phrases that count as unsupported claims.
HALLUCINATION_PHRASES = ("as an AI", "I don't have access", "based on my training", "in general", "typically", "it is commonly known", "from my knowledge", "as of my last update")
#: Phrases that mark an honest refusal.
REFUSAL_PHRASES = ("could not find supporting information", "not explicitly supported", "insufficient evidence")

#: Words left out of term overlap, by use.
STOP_GATE = ("the", "a", "an", "is", "are", "to", "for", "of", "in", "on", "how", "what", "when", "where", "why", "do", "does", "can", "i", "me", "my", "you", "your", "please", "tell", "about")
#: The stop words of English full text.
STOP_ENGLISH = (
    "i", "me", "my", "myself", "we", "our", "ours", "ourselves", "you", "your", "yours", "yourself", "yourselves", "he", "him", "his", "himself", "she", "her", "hers", "herself",
    "it", "its", "itself", "they", "them", "their", "theirs", "themselves", "what", "which", "who", "whom", "this", "that", "these", "those", "am", "is", "are", "was", "were",
    "be", "been", "being", "have", "has", "had", "having", "do", "does", "did", "doing", "a", "an", "the", "and", "but", "if", "or", "because", "as", "until", "while", "of", "at",
    "by", "for", "with", "about", "against", "between", "into", "through", "during", "before", "after", "above", "below", "to", "from", "up", "down", "in", "out", "on", "off",
    "over", "under", "again", "further", "then", "once", "here", "there", "when", "where", "why", "how", "all", "any", "both", "each", "few", "more", "most", "other", "some",
    "such", "no", "nor", "not", "only", "own", "same", "so", "than", "too", "very", "s", "t", "can", "will", "just", "don", "should", "now",
)
STOP_INTENT = (*STOP_GATE, "and", "or", "not", "this", "that", "with", "from", "it", "be", "was", "were", "been", "have", "has")
STOP_CONFIDENCE = (*STOP_INTENT, "will", "would", "could", "should", "may", "might", "shall", "must")
STOP_SENTENCE = ("this", "that", "with", "from", "have", "been", "would", "could", "should", "which", "their", "there", "these", "those", "about", "after", "before", "between", "through", "during")
