"""Ideal statevector simulation of small circuits in NumPy: feature-map kernels and encodings.

Amplitude index bits are qubits, the lowest bit the first. Backends are always ideal simulation:
no shots and no noise, so resource metadata says so.
"""

from __future__ import annotations

import numpy as np

#: Qubits beyond which 2 ** n amplitudes a row are refused.
MOST_QUBITS = 12


def _bits(n: int) -> np.ndarray:
    return (np.arange(1 << n)[:, None] >> np.arange(n)) & 1


def hadamard_all(state: np.ndarray, n: int) -> np.ndarray:
    """Hadamard on every qubit of a batch of states (rows)."""
    out = state.reshape(len(state), *[2] * n)
    for axis in range(1, n + 1):
        a, b = np.take(out, 0, axis), np.take(out, 1, axis)
        out = np.stack([a + b, a - b], axis) / np.sqrt(2)
    return out.reshape(len(state), -1)


def zz_state(x: np.ndarray, repetitions: int = 2) -> np.ndarray:
    """Amplitudes of the second-order Pauli-Z evolution map with linear entanglement (Havlicek et al. 2019).

    Each repetition: Hadamards, phases 2 x_i on qubit i, then phases 2 (pi - x_i)(pi - x_j) where
    neighbours i and j differ.
    """
    n = x.shape[1]
    if n > MOST_QUBITS:
        raise ValueError(f"{n} features need {1 << n} amplitudes; the most is {MOST_QUBITS}")
    bits = _bits(n)
    phase = 2 * x @ bits.T
    for i in range(n - 1):
        phase = phase + np.outer(2 * (np.pi - x[:, i]) * (np.pi - x[:, i + 1]), bits[:, i] ^ bits[:, i + 1])
    state = np.zeros((len(x), 1 << n), complex)
    state[:, 0] = 1
    for _ in range(repetitions):
        state = hadamard_all(state, n) * np.exp(1j * phase)
    return state


def fidelity(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """|<a|b>|^2 of all pairs of rows."""
    return np.abs(a.conj() @ b.T) ** 2


def real_amplitudes_state(angles: np.ndarray, n: int, repetitions: int = 5) -> np.ndarray:
    """One state of rotations about Y and chains of controlled NOTs; ``n * (repetitions + 1)`` angles."""
    angles = np.asarray(angles, float).reshape(repetitions + 1, n)
    state = np.zeros(1 << n)
    state[0] = 1
    index = np.arange(1 << n)
    for r, layer in enumerate(angles):
        for q, t in enumerate(layer):
            partner = state[index ^ (1 << q)]
            sign = np.where((index >> q) & 1, 1.0, -1.0)
            state = np.cos(t / 2) * state + sign * np.sin(t / 2) * partner
        if r < repetitions:
            for q in range(n - 1):
                state = state[np.where((index >> q) & 1, index ^ (1 << (q + 1)), index)]
    return state


def amplitude_encoding(x: np.ndarray) -> np.ndarray:
    """Rows over their length, padded with zeros to a power of two."""
    size = 1 << max(0, (x.shape[1] - 1).bit_length())
    out = np.zeros((len(x), size))
    out[:, : x.shape[1]] = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    return out


def domain_wall(n: int, wall: int) -> np.ndarray:
    """The basis state with ones on the qubits from ``wall`` on."""
    out = np.zeros(1 << n)
    out[sum(1 << q for q in range(wall, n))] = 1
    return out


def swap_test_one(a: np.ndarray, b: np.ndarray) -> float:
    """Probability of reading 1 in a swap test of two states."""
    return float((1 - np.abs(np.vdot(a, b)) ** 2) / 2)


def resources(n: int, repetitions: int) -> dict[str, str]:
    """Metadata of a feature-map kernel entry; depth counts a map and its inverse."""
    return {"backend": "ideal statevector simulation", "qubits": str(n), "circuit_depth": str(2 * repetitions * (2 + 3 * max(0, n - 1))), "shots": "", "noise_model": ""}
