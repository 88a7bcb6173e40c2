"""Layouts of resonance parameters, angular, energy and product distributions and covariances.

The notation is that of :mod:`notation`, variable names those of the public format manual.
"""

from __future__ import annotations

from textwrap import indent

from .resonance_covariances import MULTILEVEL, RESONANCE_COVARIANCES


def _within(levels: int, text: str) -> str:
    return indent(text.strip("\n"), "    " * levels)


#: Resolved resonances of one l: widths by formalism.
_RESOLVED = """
for n = 1..NLS
    section l_group[n]
        list AWRI {second} L {flag} 6*NRS NRS
            for r = 1..NRS
                vals ER[r] AJ[r] {widths}
"""
_RMATRIX = """
cont 0 0 IFG KRM NJS KRL
list 0 0 NPP 0 12*NPP 2*NPP
    for p = 1..NPP
        vals MA[p] MB[p] ZA[p] ZB[p] IA[p] IB[p] Q[p] PNT[p] SHF[p] MT[p] PA[p] PB[p]
for j = 1..NJS
    section j_group[j]
        list AJ PJ KBK KPS 6*NCH NCH
            for c = 1..NCH
                vals PPI[c] L[c] SCH[c] BND[c] APE[c] APT[c]
        list 0 0 0 NRS NVS NX
            for r = 1..NRS
                vals ER[r]
                for c = 1..NCH
                    vals GAM[r,c]
                pad
            if NRS == 0
                vals 0 0 0 0 0 0
        if KBK > 0
            stop background terms are not covered
        if KPS > 0
            stop tabulated phase shifts are not covered
"""
_UNRESOLVED = """
if LFW == 0 and LRF == 1
    cont SPI AP LSSF 0 NLS 0
    for n = 1..NLS
        section l_group[n]
            list AWRI 0 L 0 6*NJS NJS
                for j = 1..NJS
                    vals D[j] AJ[j] AMUN[j] GNO[j] GG[j] 0
elif LFW == 1 and LRF == 1
    list SPI AP LSSF 0 NE NLS
        for e = 1..NE
            vals ES[e]
    let NW = NE+6
    for n = 1..NLS
        section l_group[n]
            cont AWRI 0 L 0 NJS 0
            for j = 1..NJS
                section j_group[j]
                    list 0 0 L MUF NW 0
                        vals D AJ AMUN GNO GG 0
                        for e = 1..NE
                            vals GF[e]
else
    cont SPI AP LSSF 0 NLS 0
    for n = 1..NLS
        section l_group[n]
            cont AWRI 0 L 0 NJS 0
            for j = 1..NJS
                section j_group[j]
                    list AJ 0 INT 0 6*NE+6 NE
                        vals 0 0 AMUX AMUN AMUG AMUF
                        for e = 1..NE
                            vals ES[e] D[e] GX[e] GNO[e] GG[e] GF[e]
"""
RESONANCES = f"""
cont ZA AWR 0 0 NIS 0
for i = 1..NIS
    section isotope[i]
        cont ZAI ABN 0 LFW NER 0
        for k = 1..NER
            section range[k]
                cont EL EH LRU LRF NRO NAPS
                if NRO != 0
                    tab1 0 0 0 0 -> AP_table E AP
                if LRU == 0
                    cont SPI AP 0 0 NLS 0
                elif LRU == 1
                    if LRF == 1 or LRF == 2
                        cont SPI AP 0 0 NLS 0
{_within(6, _RESOLVED.format(second="QX", flag="LRX", widths="GT[r] GN[r] GG[r] GF[r]"))}
                    elif LRF == 3
                        cont SPI AP LAD 0 NLS NLSC
{_within(6, _RESOLVED.format(second="APL", flag="0", widths="GN[r] GG[r] GFA[r] GFB[r]"))}
                    elif LRF == 7
{_within(6, _RMATRIX)}
                    elif LRF == 4
{_within(6, MULTILEVEL)}
                    else
                        stop this resonance formalism is not covered
                else
{_within(5, _UNRESOLVED)}
"""

_LEGENDRE = """
for k = {first}..{last}
    list T[k] E[k] LT[k] 0 NL[k] 0
        for l = 1..NL[k]
            vals a[k,l]
"""
_TABULATED = """
for k = {first}..{last}
    section distribution[k]
        tab1 T E LT 0 -> table mu f
"""
ANGULAR = f"""
cont ZA AWR 0 LTT 0 0
cont 0 AWR LI LCT 0 NM
if LTT == 1
    tab2 0 0 0 0 NE -> leg_int
{_within(1, _LEGENDRE.format(first="1", last="NE"))}
elif LTT == 2
    tab2 0 0 0 0 NE -> ang_int
{_within(1, _TABULATED.format(first="1", last="NE"))}
elif LTT == 3
    tab2 0 0 0 0 NE1 -> leg_int
{_within(1, _LEGENDRE.format(first="1", last="NE1"))}
    tab2 0 0 0 0 NE2 -> ang_int
{_within(1, _TABULATED.format(first="NE1", last="NE1+NE2-1"))}
"""
SPECTRA = """
cont ZA AWR 0 0 NK 0
for k = 1..NK
    section contribution[k]
        tab1 U 0 0 LF -> p_table E p
        if LF == 1
            tab2 0 0 0 0 NE
            for i = 1..NE
                section spectrum[i]
                    tab1 0 E 0 0 -> table Eout g
        elif LF == 5
            tab1 0 0 0 0 -> theta_table E theta
            tab1 0 0 0 0 -> g_table x g
        elif LF == 7 or LF == 9
            tab1 0 0 0 0 -> theta_table E theta
        elif LF == 12
            tab1 EFL EFH 0 0 -> TM_table E TM
        else
            stop this energy law is not covered
"""
PRODUCTS = """
cont ZA AWR JP LCT NK 0
for i = 1..NK
    section subsection[i]
        tab1 ZAP AWP LIP LAW -> yields E y
        if LAW == 1
            tab2 0 0 LANG LEP NE
            for j = 1..NE
                list 0 E[j] ND[j] NA[j] NW[j] NEP[j]
                    for k = 1..NEP[j]
                        vals Ep[j,k]
                        for m = 0..NA[j]
                            vals b[j,k,m]
        elif LAW == 2
            tab2 0 0 0 0 NE
            for j = 1..NE
                list 0 E[j] LANG[j] 0 NW[j] NL[j]
                    for k = 1..NW[j]
                        vals A[j,k]
        elif LAW == 5
            tab2 SPI 0 LIDP 0 NE
            for j = 1..NE
                list 0 E[j] LTP[j] 0 NW[j] NL[j]
                    for k = 1..NW[j]
                        vals A[j,k]
        elif LAW == 6
            cont APSX 0 0 0 0 NPSX
        elif LAW == 7
            tab2 0 0 0 0 NE
            for j = 1..NE
                section incident[j]
                    tab2 0 E 0 0 NMU
                    for k = 1..NMU
                        section direction[k]
                            tab1 0 mu 0 0 -> table Ep f
"""
PHOTON_ANGLES = """
cont ZA AWR LI LTT NK NI
if LI == 0
    for i = 1..NI
        section isotropic[i]
            cont EG ES 0 0 0 0
    for i = NI+1..NK
        section photon[i]
            tab2 EG ES 0 0 NE
            for k = 1..NE
                if LTT == 1
                    list 0 E[k] 0 0 NL[k] 0
                        for l = 1..NL[k]
                            vals a[k,l]
                else
                    section direction[k]
                        tab1 0 E 0 0 -> table mu p
"""

#: Parts of a covariance: sums of other reactions' and matrices of its own.
_PARTS = """
for c = 1..NC
    section nc_part[c]
        cont 0 0 0 LTY 0 0
        if LTY == 0
            list E1 E2 0 0 2*NCI NCI
                for i = 1..NCI
                    vals C[i] XMT[i]
        else
            list E1 E2 MATS MTS 2*NEI+2 NEI
                vals XMFS XLFSS
                for i = 1..NEI
                    vals EI[i] WEI[i]
for c = 1..NI
    section ni_part[c]
        if LB == 5 ~1
            list 0 0 LS LB NT NE
                for k = 1..NE
                    vals E[k]
                for k = 1..NE-1
                    if LS == 1
                        for m = k..NE-1
                            vals F[k,m]
                    else
                        for m = 1..NE-1
                            vals F[k,m]
        elif LB == 6 ~1
            list 0 0 0 LB NT NER
                for k = 1..NER
                    vals ER[k]
                for m = 1..(NT-1)/NER
                    vals EC[m]
                for k = 1..NER-1
                    for m = 1..(NT-1)/NER-1
                        vals F[k,m]
        else
            list 0 0 LT LB 2*NP NP
                for k = 1..NP-LT
                    vals E[k] F[k]
                for k = 1..LT
                    vals EL[k] FL[k]
"""
COVARIANCES = f"""
cont ZA AWR 0 MTL 0 NL
for n = 1..NL
    section subsection[n]
        cont XMF1 XLFS1 MAT1 MT1 NC NI
{_within(2, _PARTS)}
"""
STATE_COVARIANCES = f"""
cont ZA AWR LIS 0 NS 0
for s = 1..NS
    section subsection[s]
        cont QM QI IZAP LFS 0 NL
        for n = 1..NL
            section subsubsection[n]
                cont XMF1 XLFS1 MAT1 MT1 NC NI
{_within(4, _PARTS)}
"""

DELAYED = """
cont ZA AWR LDG LNU 0 0
if LDG == 0
    list 0 0 0 0 NNF 0
        for i = 1..NNF
            vals lambda_[i]
else
    tab2 0 0 0 0 NE
    for k = 1..NE
        list 0 E[k] 0 0 2*NNF 0
            for i = 1..NNF
                vals lambda_[k,i] alpha[k,i]
if LNU == 1
    list 0 0 0 0 NC 0
        for c = 1..NC
            vals nu_d[c]
else
    tab1 0 0 0 0 -> nubar_table Eint nubar
"""
FISSION_ENERGY = """
cont ZA AWR 0 LFC 0 NFC
list 0 0 0 NPLY 18*(NPLY+1) 9*(NPLY+1)
    for n = 0..NPLY
        vals EFR[n] DEFR[n] ENP[n] DENP[n] END[n] DEND[n] EGP[n] DEGP[n] EGD[n] DEGD[n] EB[n] DEB[n] ENU[n] DENU[n] ER[n] DER[n] ET[n] DET[n]
if LFC == 1
    for i = 1..NFC
        section component[i]
            tab1 0 0 LDRV IFC -> table E EIFC
"""
DELAYED_PHOTONS = """
if LO == 1 ~1
    cont ZA AWR LO 0 NG 0
    for i = 1..NG
        section photon[i]
            tab1 E 0 i 0 -> table t T
else
    cont ZA AWR LO 0 0 0
    list 0 0 0 0 NNF 0
        for i = 1..NNF
            vals lambda_[i]
"""
THERMAL = """
cont ZA AWR 0 LAT LASYM 0
list 0 0 LLN 0 6*NS+6 NS
    for k = 1..6*NS+6
        vals B[k]
tab2 0 0 0 0 NB -> beta_int
for b = 1..NB
    section beta_group[b]
        tab1 T0 beta LT 0 -> S_table alpha S
        for t = 1..LT
            list T[t] beta LI[t] 0 NP[t] 0
                for k = 1..NP[t]
                    vals S[t,k]
tab1 0 0 0 0 -> teff0_table Tint Teff0
for n = 1..NS
    if B[6*n+1] == 0
        section teff[n]
            tab1 0 0 0 0 -> table Tint Teff
"""
MULTIPLICITIES = """
if LO == 1 ~1
    cont ZA AWR LO LG NK 0
    if NK > 1
        tab1 0 0 0 0 -> total E y
    for i = 1..NK
        section subsection[i]
            tab1 EG ES LP LF -> table E y
else
    cont ZA AWR LO LG NS 0
    list ES_NS 0 LP 0 (LG+1)*NT NT
        for i = 1..NT
            vals ES[i] TP[i]
            if LG == 2
                vals GP[i]
"""

BY_SECTION: dict[tuple[int, int], str] = {
    (1, 455): DELAYED,
    (1, 458): FISSION_ENERGY,
    (1, 460): DELAYED_PHOTONS,
    (2, 151): RESONANCES,
    (32, 151): RESONANCE_COVARIANCES,
    (4, -1): ANGULAR,
    (5, -1): SPECTRA,
    (6, -1): PRODUCTS,
    (7, 4): THERMAL,
    (12, -1): MULTIPLICITIES,
    (14, -1): PHOTON_ANGLES,
    (31, -1): COVARIANCES,
    (33, -1): COVARIANCES,
    (40, -1): STATE_COVARIANCES,
}
