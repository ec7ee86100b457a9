"""Fixed values of the quality policy."""

from __future__ import annotations

# Must equal the policy for right results.
FIT_LEVELS = ("excellent", "good", "partial", "poor", "complete_mismatch")
FIT_FLOORS = {"excellent": 0.80, "good": 0.60, "partial": 0.40, "poor": 0.20}
FIT_BANDS = {"excellent": (0.80, 1.00), "good": (0.60, 0.79), "partial": (0.40, 0.59), "poor": (0.20, 0.39), "complete_mismatch": (0.00, 0.19)}
PROFICIENCIES = ("beginner", "intermediate", "advanced", "expert")
SENIORITIES = ("entry_level", "mid_level", "senior")
SENIORITY_SCORE = {"entry_level": 0, "mid_level": 1, "senior": 2, "lead": 3, "executive": 4}
EXECUTIVE_TITLES = ("vp", "vice president", "chief", "cto", "ceo", "executive")
LEAD_TITLES = ("director", "head of", "lead", "principal")
CORE_SKILLS = 3
ENTRY_MOST_EXPERT, ENTRY_MOST_SKILLS = 10, 20
SUSPICIOUS_PHRASES = ("expert in all", "certified in everything")
BUZZWORD_LIMIT = 5
REPEAT_WINDOW, REPEAT_COUNT = 10, 3
LOCAL_WINDOW, LOCAL_COUNT, LOCAL_CHARS = 8, 3, 4
BOUNDARY_MARGIN = 0.03
AUDIT_RATE = 0.10
JUDGE_FLAG_BELOW, JUDGE_RECOMMEND_BELOW = 0.40, 0.70
POLICY_ID = "benchmark_policy_v1"
FLAGS = ("experience_mismatch", "seniority_mismatch", "missing_core_skills", "hallucinated_skills", "awkward_language")
ERROR_CATEGORIES = ("missing_required_fields", "type_mismatches", "format_violations", "enum_mapping_failures", "logical_inconsistencies")
BUZZWORDS = (
    "synergy", "leverage", "leveraging", "dynamic", "results-driven", "passionate", "innovative", "cutting-edge",
    "best-in-class", "visionary", "strategic", "thought leader", "proactive", "self-starter", "team player",
    "detail-oriented", "go-getter", "fast-paced", "game-changer", "robust", "scalable", "paradigm", "value-add",
    "impactful", "mission-critical", "cross-functional", "transformational", "stakeholder management",
    "outside the box", "move the needle", "world-class", "disruptive", "seamless",
)
LATENCY_TARGETS = {"rules_only": 2.0, "with_judge": 10.0}
CORRECTION_TARGET = 0.5
STAGES = ("generation", "validation", "analysis", "correction", "visualization", "api_benchmark")
