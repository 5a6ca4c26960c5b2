"""One training run at a time beside a service: asked for any number of times, run once more at most, the model swapped when it is whole."""

from __future__ import annotations

import os
import threading
import time
from collections import deque
from collections.abc import Callable

LOG_LINES = 40


class TrainingJob:
    """``train(path, say)`` writes a model to a path of its own; requests that come while it runs lead to one more run."""

    def __init__(self, train: Callable[[str, Callable[[str], None]], None], model_path: str, swapped: Callable[[], None] = lambda: None):
        self.train, self.model_path, self.swapped = train, model_path, swapped
        self.lock, self.thread, self.next_reason = threading.Lock(), None, None
        self.log: deque[str] = deque(maxlen=LOG_LINES)
        self.found = {"state": "idle", "reason": "", "error": "", "started": 0.0, "ended": 0.0, "runs": 0, "last_seconds": 0.0}

    def request(self, reason: str) -> dict:
        with self.lock:
            self.next_reason = reason
            if self.thread is None or not self.thread.is_alive():
                self.thread = threading.Thread(target=self._work, daemon=True)
                self.thread.start()
        return self.status()

    def _work(self) -> None:
        while True:
            with self.lock:
                if self.next_reason is None:
                    self.thread = None
                    return
                reason, self.next_reason = self.next_reason, None
                self.found |= {"state": "running", "reason": reason, "error": "", "started": time.time(), "ended": 0.0}
            own = f"{self.model_path}.{os.getpid()}.new"
            try:
                self.train(own, self.log.append)
                os.replace(own, self.model_path)
                self.swapped()
                state, error = "done", ""
            except Exception as e:  # the run ends, the service goes on
                state, error = "failed", f"{type(e).__name__}: {e}"
                self.log.append(error)
            finally:
                if os.path.exists(own):
                    os.remove(own)
            with self.lock:
                now = time.time()
                self.found |= {"state": state, "error": error, "ended": now, "runs": self.found["runs"] + 1, "last_seconds": now - self.found["started"]}

    def status(self) -> dict:
        """State, reason, error, times, the log's last lines, and a running one's share of the last run's time."""
        with self.lock:
            out = {**self.found, "log": list(self.log), "queued": self.next_reason is not None}
        last = out["last_seconds"]
        out["progress"] = 1.0 if out["state"] == "done" else min(0.95, (time.time() - out["started"]) / last) if out["state"] == "running" and last else 0.0
        return out

    def wait(self) -> None:
        while (thread := self.thread) is not None:
            thread.join()
