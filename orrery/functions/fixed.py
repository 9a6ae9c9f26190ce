"""Colours, sheens, texture palettes, camera models and thresholds that results depend on."""

# Named colours, in the order in which a prompt is searched for them.
NAMED_COLOURS = {
    "red": (220, 30, 30),
    "green": (30, 180, 30),
    "blue": (30, 80, 220),
    "yellow": (240, 220, 20),
    "orange": (240, 120, 10),
    "purple": (140, 30, 200),
    "pink": (240, 80, 160),
    "cyan": (20, 200, 220),
    "white": (255, 255, 255),
    "black": (0, 0, 0),
    "grey": (128, 128, 128),
    "gray": (128, 128, 128),
    "brown": (120, 70, 30),
    "gold": (212, 175, 55),
    "silver": (192, 192, 192),
    "bronze": (205, 127, 50),
    "navy": (10, 30, 100),
    "teal": (10, 140, 140),
    "magenta": (210, 20, 180),
    "lime": (100, 220, 20),
    "maroon": (128, 0, 0),
    "olive": (128, 128, 0),
    "coral": (255, 80, 60),
    "indigo": (75, 0, 130),
    "violet": (140, 60, 200),
    "crimson": (220, 20, 60),
    "turquoise": (64, 224, 208),
    "beige": (245, 245, 220),
    "ivory": (255, 255, 240),
}

# Colour of the highlight of a metal.
METALLIC_SHEEN = {"gold": (255, 210, 40), "silver": (210, 215, 225), "bronze": (220, 140, 50), "copper": (200, 110, 50)}

# Base colour of a metal in image edits.
METALLIC_BASE = {"gold": (212, 175, 55), "silver": (180, 180, 190), "bronze": (180, 110, 40), "copper": (160, 90, 40)}

# Texture palettes as (weight, colour), in the order in which a prompt is searched for them.
TEXTURE_PALETTES = {
    "wood": ((0.35, (160, 90, 40)), (0.30, (140, 75, 30)), (0.20, (180, 110, 55)), (0.15, (200, 130, 70))),
    "marble": ((0.45, (240, 238, 232)), (0.25, (200, 195, 185)), (0.20, (160, 155, 148)), (0.10, (80, 80, 80))),
    "rust": ((0.40, (150, 55, 15)), (0.30, (180, 80, 20)), (0.20, (100, 40, 10)), (0.10, (60, 30, 5))),
    "concrete": ((0.50, (150, 150, 148)), (0.30, (130, 130, 128)), (0.20, (170, 168, 165))),
    "glass": ((0.60, (200, 220, 240)), (0.40, (180, 200, 220))),
    "ceramic": ((0.55, (245, 240, 235)), (0.30, (230, 225, 218)), (0.15, (215, 210, 200))),
    "leather": ((0.45, (80, 45, 20)), (0.35, (60, 35, 15)), (0.20, (100, 60, 30))),
}

# Real spherical harmonics, degree 0 to 4.
SH0 = 0.28209479177387814
SH1 = 0.4886025119029199
SH2 = (1.0925484305920792, -1.0925484305920792, 0.31539156525252005, -1.0925484305920792, 0.5462742152960396)
SH3 = (-0.5900435899266435, 2.890611442640554, -0.4570457994644658, 0.3731763325901154, -0.4570457994644658, 1.445305721320277, -0.5900435899266435)
SH4 = (2.5033429417967046, -1.7701307697799304, 0.9461746957575601, -0.6690465435572892, 0.10578554691520431, -0.6690465435572892, 0.47308734787878004, -1.7701307697799304, 0.6258357354491761)
