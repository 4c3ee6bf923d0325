"""How a processed frame compares with its original: grain, sharpness, flicker, line art."""

from __future__ import annotations

import numpy as np

from cadence.kernels import plane

CROP = 0.12


def flat(frame: np.ndarray) -> np.ndarray:
    """Even ground away from the border."""
    y = plane.gray(frame)
    out = np.zeros(y.shape, bool)
    a, b = int(y.shape[0] * CROP), int(y.shape[1] * CROP)
    inner = np.s_[a : y.shape[0] - a, b : y.shape[1] - b]
    out[inner] = (np.hypot(*plane.sobel(plane.blur(y, 7))) < 15)[inner]
    return out


def hf_noise(frame: np.ndarray) -> float:
    mask = flat(frame)
    return float(plane.laplacian(plane.gray(frame))[mask].std()) if mask.any() else 0.0


def sharpness(frame: np.ndarray) -> float:
    edge = plane.canny(np.clip(plane.gray(frame), 0, 255).astype(np.uint8))
    return float(np.hypot(*plane.sobel(plane.gray(frame)))[edge].mean()) if edge.any() else 0.0


def flicker(pairs: list[tuple[np.ndarray, np.ndarray]]) -> float:
    found = [np.abs(plane.gray(a) - plane.gray(b))[flat(a)] for a, b in pairs]
    found = [float(x.mean()) for x in found if x.size]
    return float(np.mean(found)) if found else 0.0


def line_iou(a: np.ndarray, b: np.ndarray) -> float:
    x, y = (plane.line_art(plane.median3(f), 1) for f in (a, b))
    return float((x & y).sum() / max(int((x | y).sum()), 1))


def verdict(iou: float, own: float | None) -> str:
    """own: the original's agreement with its own next frame."""
    if iou >= 0.75 or (own is not None and iou >= own):
        return "ok"
    return "caution" if iou >= 0.6 else "broken"


def report(original: list[np.ndarray], processed: list[np.ndarray]) -> dict:
    """Means over frames in order; consecutive frames are pairs."""
    both = lambda f: {"original": f(original), "processed": f(processed)}
    mean = lambda g: lambda frames: float(np.mean([g(x) for x in frames])) if frames else 0.0
    iou = float(np.mean([line_iou(a, b) for a, b in zip(original, processed, strict=True)])) if original else 0.0
    own = float(np.mean([line_iou(a, b) for a, b in zip(original, original[1:], strict=False)])) if len(original) > 1 else None
    pairs = lambda x: list(zip(x, x[1:], strict=False))
    return {"flat_hf_noise": both(mean(hf_noise)), "edge_sharpness": both(mean(sharpness)), "temporal_flicker": both(lambda x: flicker(pairs(x))), "line_art_iou": iou, "line_art_iou_self": own, "verdict": verdict(iou, own)}
