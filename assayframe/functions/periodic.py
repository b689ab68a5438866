"""Fixed values about the chemical elements."""

# Element symbols in order of atomic number, 1 to 118.
SYMBOLS = (
    "H He Li Be B C N O F Ne Na Mg Al Si P S Cl Ar K Ca Sc Ti V Cr Mn Fe Co Ni Cu Zn Ga Ge As Se Br Kr "
    "Rb Sr Y Zr Nb Mo Tc Ru Rh Pd Ag Cd In Sn Sb Te I Xe Cs Ba La Ce Pr Nd Pm Sm Eu Gd Tb Dy Ho Er Tm Yb Lu "
    "Hf Ta W Re Os Ir Pt Au Hg Tl Pb Bi Po At Rn Fr Ra Ac Th Pa U Np Pu Am Cm Bk Cf Es Fm Md No Lr "
    "Rf Db Sg Bh Hs Mt Ds Rg Cn Nh Fl Mc Lv Ts Og"
).split()

def atomic_number(symbol: str) -> int:
    return SYMBOLS.index(symbol) + 1


def is_f_block(symbol: str) -> bool:
    """Lanthanoids are 57 to 71, actinoids 89 to 103."""
    z = atomic_number(symbol)
    return 57 <= z <= 71 or 89 <= z <= 103
