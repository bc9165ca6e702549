from tidegap.functions.ranges import exp_range, exp_range_cover, exp_range_inc
from tidegap.functions.scores import mae, rmse
from tidegap.functions.timegrid import div, epoch_micros, floor_div, slot_number

__all__ = [
    "div",
    "epoch_micros",
    "exp_range",
    "exp_range_cover",
    "exp_range_inc",
    "floor_div",
    "mae",
    "rmse",
    "slot_number",
]
