"""Feature plans: which stages run, with which parameters, and which columns come out."""
from barloom.plans.features import FeaturePlan, Mode, atr_smooth, darvas_box, hma, hma_atr_smooth

__all__ = ["FeaturePlan", "Mode", "atr_smooth", "darvas_box", "hma", "hma_atr_smooth"]
