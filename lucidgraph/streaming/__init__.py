from .trials import stream_trials, trial_status

__all__ = ["stream_trials", "trial_status"]
