"""Word lists, weights and thresholds. All are parameters of the operators; these are the defaults."""

from __future__ import annotations

from dataclasses import dataclass, field

# They must be these for results to agree.
DARVO = ["you always", "you never", "it's your fault", "i'm the victim", "you made me", "look what you did", "you're crazy", "that never happened", "you're imagining"]
GASLIGHTING = ["you're being paranoid", "that's not what happened", "you're too sensitive", "i never said that", "you're remembering it wrong", "you're overreacting"]
GASLIGHTING_PATTERNS = [
    r"you('re| are) (being )?(too |so )?(sensitive|dramatic|crazy|paranoid)",
    r"(that|it) (never|didn't) happen",
    r"you('re| are) (imagining|making) (things|it) up",
    r"no one (else |ever )?(thinks|believes|said)",
    r"you (always|never) (do|say|remember)",
]
MANIPULATION = ["if you loved me", "after all i've done", "you owe me", "you made me do", "no one else would", "you're lucky i", "don't tell anyone", "this is your fault"]
QUALIFIERS = ["honestly", "truthfully", "to be honest", "believe me", "i swear", "trust me", "frankly"]
DISTANCING = ["that person", "that thing", "those people", "one might", "someone", "they say"]
FORMAL = [" did not ", " do not ", " was not ", " is not ", " would not ", " could not "]
HEDGES = ["maybe", "perhaps", "possibly", "might", "could be", "sort of", "kind of", "i think", "i guess", "probably"]
CERTAINTY = ["definitely", "certainly", "absolutely", "always", "never", "must", "have to", "obviously", "clearly"]
EMOTIONS = ["hate", "love", "furious", "terrified", "ecstatic", "devastated", "amazing", "horrible", "disgusting"]
BEHAVIORS = ["normal", "darvo", "gaslighting", "manipulation", "aggressive", "defensive"]


@dataclass(frozen=True)
class Lexicon:
    """The phrase lists that scoring uses."""

    darvo: list[str] = field(default_factory=lambda: DARVO)
    gaslighting: list[str] = field(default_factory=lambda: GASLIGHTING)
    gaslighting_patterns: list[str] = field(default_factory=lambda: GASLIGHTING_PATTERNS)
    manipulation: list[str] = field(default_factory=lambda: MANIPULATION)
    qualifiers: list[str] = field(default_factory=lambda: QUALIFIERS)
    distancing: list[str] = field(default_factory=lambda: DISTANCING)
    formal: list[str] = field(default_factory=lambda: FORMAL)
    hedges: list[str] = field(default_factory=lambda: HEDGES)
    certainty: list[str] = field(default_factory=lambda: CERTAINTY)
    emotions: list[str] = field(default_factory=lambda: EMOTIONS)


@dataclass(frozen=True)
class Fusion:
    """Weights of the late fusion and thresholds of the gate."""

    alpha: float = 0.85
    flag_above: float = 0.7
    deception: float = 0.7
    manipulation: float = 0.7
    least_score: float = 0.3
    least_chars: int = 50
    least_confidence: float = 0.5
    outlier: float = 0.3
    low_confidence: float = 0.3
