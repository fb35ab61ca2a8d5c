"""A box room with exact truth: points on its six faces, an optional door and window, and cameras inside."""

import numpy as np
import pandas as pd


def box_room(scan_id=1, size=(5.0, 4.0, 2.7), spacing=0.05, noise=0.002, scale=1.0, tilt=0.0, yaw=0.0, door=True, window=True, furniture=True, seed=7, side=False):
    rng = np.random.default_rng(seed)
    w, d, h = size
    parts = []

    def face(origin, a, b, la, lb, keep=None):
        u, v = np.meshgrid(np.arange(spacing / 2, la, spacing), np.arange(spacing / 2, lb, spacing), indexing="ij")
        u, v = u.ravel(), v.ravel()
        if keep is not None:
            ok = keep(u, v)
            u, v = u[ok], v[ok]
        n = np.cross(a, b)
        p = np.asarray(origin) + u[:, None] * np.asarray(a) + v[:, None] * np.asarray(b)
        parts.append((p + rng.normal(0, noise, len(p))[:, None] * n, np.repeat(n[None, :], len(p), 0)))

    ex, ey, ez = np.eye(3)
    face((0, 0, 0), ex, ey, w, d)  # floor, normal +z
    face((0, d, h), ex, -ey, w, d)  # ceiling, normal -z
    face((w, 0, 0), -ex, ez, w, h, (lambda u, v: ~((np.abs(w - u - 2.0) < 0.45) & (v < 2.05))) if door else None)  # y = 0, normal +y
    face((0, d, 0), ex, ez, w, h, (lambda u, v: ~((np.abs(u - 2.5) < 0.6) & (v > 0.9) & (v < 2.0))) if window else None)  # y = d, normal -y
    face((0, 0, 0), ey, ez, d, h)  # x = 0, normal +x
    face((w, d, 0), -ey, ez, d, h, (lambda u, v: ~((np.abs(d - u - 2.2) < 0.4) & (v > 0.7) & (v < 1.9))) if side else None)  # x = w, normal -x
    if side:  # its reveals, and what lies behind it
        y, s = np.meshgrid(np.arange(1.8, 2.6, 0.02), np.arange(0.02, 0.075, 0.01), indexing="ij")
        for z0 in (0.7, 1.9):
            parts.append((np.stack([w - s.ravel(), y.ravel(), np.full(y.size, z0)], 1), np.repeat([[0.0, 0.0, 1.0]], y.size, 0)))
        z, s = np.meshgrid(np.arange(0.7, 1.9, 0.02), np.arange(0.02, 0.075, 0.01), indexing="ij")
        for y0 in (1.8, 2.6):
            parts.append((np.stack([w - s.ravel(), np.full(z.size, y0), z.ravel()], 1), np.repeat([[0.0, 1.0, 0.0]], z.size, 0)))
    if window:  # reveals 7 cm deep into the room side, so the aperture shows depth
        for z0 in (0.9, 2.0):
            u, s = np.meshgrid(np.arange(1.9, 3.1, 0.02), np.arange(0.02, 0.075, 0.01), indexing="ij")
            parts.append((np.stack([u.ravel(), d - s.ravel(), np.full(u.size, z0)], 1), np.repeat([[0.0, 0.0, 1.0]], u.size, 0)))
        for x0 in (1.9, 3.1):
            v, s = np.meshgrid(np.arange(0.9, 2.0, 0.02), np.arange(0.02, 0.075, 0.01), indexing="ij")
            parts.append((np.stack([np.full(v.size, x0), d - s.ravel(), v.ravel()], 1), np.repeat([[1.0, 0.0, 0.0]], v.size, 0)))
    if door:  # what lies behind the doorway
        u, v = np.meshgrid(np.arange(1.6, 2.4, 0.05), np.arange(0.05, 2.0, 0.05), indexing="ij")
        parts.append((np.stack([u.ravel(), np.full(u.size, -0.5), v.ravel()], 1), np.repeat([[0.0, 1.0, 0.0]], u.size, 0)))
    if furniture:
        x, y, z = (g.ravel() for g in np.meshgrid(np.arange(3.2, 4.2, 0.05), np.arange(1.4, 2.2, 0.05), np.arange(0.0, 0.75, 0.05), indexing="ij"))
        edge = (x < 3.22) | (x > 4.13) | (y < 1.42) | (y > 2.13) | (z > 0.68)
        parts.append((np.stack([x, y, z], 1)[edge], np.repeat([[0.0, 0.0, 1.0]], edge.sum(), 0)))
    p, n = np.concatenate([a for a, _ in parts]), np.concatenate([b for _, b in parts])
    a, b = np.radians(tilt), np.radians(yaw)
    rot = np.array([[1, 0, 0], [0, np.cos(a), -np.sin(a)], [0, np.sin(a), np.cos(a)]]) @ np.array([[np.cos(b), -np.sin(b), 0], [np.sin(b), np.cos(b), 0], [0, 0, 1]])
    p, n = (p @ rot.T) * scale, n @ rot.T
    df = pd.DataFrame({"scan_id": scan_id, "point_id": np.arange(len(p)), "x": p[:, 0], "y": p[:, 1], "z": p[:, 2], "nx": n[:, 0], "ny": n[:, 1], "nz": n[:, 2]})
    k = np.arange(24)
    c = np.stack([1 + 0.12 * k, 1.5 + 0.8 * np.sin(k / 3.0), np.full(24, 1.5)], 1) @ rot.T * scale
    return df, pd.DataFrame({"scan_id": scan_id, "cam_id": k, "x": c[:, 0], "y": c[:, 1], "z": c[:, 2]}), rot
